import math
import random
from collections import Counter
from specgraph.llm import lm

TEXTS = ["the cat sat on the mat", "the cat sat on the dog", "The  DOG\tsat on the cat\n", "", None, "the cat sat", "É é unseen words here", "the cat sat on the mat", "x " * 4000]


def run(spark, monkeypatch=None):
    rows = [(i, t, i in (5, 6), "z") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, score string")
    return rows, {r.doc_id: r for r in lm.score(docs.select("doc_id", "text", "held")).collect()}


def test_base_and_counts(spark, monkeypatch):
    for chars in (16_000_000, 30):  # one chunk, several chunks
        monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
        rows, got = run(spark)
        seq = {i: [*lm.words(t), b" end"] for i, t, _, _ in rows}
        c = Counter(w for i, _, held, _ in rows if not held for w in seq[i])
        n, v = sum(c.values()), len(c)
        for i, _, held, _ in rows:
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(seq[i]), sum(c[w] > 0 for w in seq[i]), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq[i]), rel_tol=1e-9)


def test_model_is_a_distribution_and_beats_base(spark):
    rows, got = run(spark)
    assert got[5].score > got[5].base_score and all(r.score < 0 for r in got.values())
    assert got[0].score == got[7].score


def plain(rows, order):
    """The same model by an unbinned EM over every training token, one order after the other."""
    seqs = {i: [*lm.words(t), b" end"] for i, t, _ in rows}
    train = [i for i, _, held in rows if not held]
    pad = {i: [b" bos"] * (order - 1) + s for i, s in seqs.items()}
    grams = lambda i, k: [tuple(pad[i][j - k + 1 : j + 1]) for j in range(order - 1, len(pad[i]))]
    count = {k: Counter(g for i in train for g in grams(i, k)) for k in range(1, order + 1)}
    context = {k: Counter(g[:-1] for i in train for g in grams(i, k)) for k in range(1, order + 1)}
    v = len(count[1])
    weights = {}

    def mixed(i, less, upto):
        out = []
        for j in range(len(seqs[i])):
            p = 1 / (v + 1)
            for k in range(1, upto + 1):
                g = grams(i, k)[j]
                seen = max(context[k][g[:-1]] - less, 0)
                w = weights[k].get(int(2 * math.log2(seen + 1)), 0.5) if seen else 0.0
                p = w * max(count[k][g] - less, 0) / max(seen, 1) + (1 - w) * p
            out.append(p)
        return out

    for k in range(1, order + 1):
        events = []
        for i in train:
            for g, p in zip(grams(i, k), mixed(i, 1, k - 1)):
                seen = context[k][g[:-1]] - 1
                events.append((int(2 * math.log2(seen + 1)), max(count[k][g] - 1, 0) / max(seen, 1) / p))
        w = dict.fromkeys({b for b, _ in events}, 0.5)
        for _ in range(100):
            post, n = Counter(), Counter()
            for b, r in events:
                post[b] += w[b] * r / (w[b] * r + 1 - w[b])
                n[b] += 1
            w = {b: (1 + post[b]) / (2 + n[b]) for b in w}
        weights[k] = w
    total = lambda i, less: sum(map(math.log10, mixed(i, less, order)))
    return {i: (total(i, int(i in train)), total(i, 0)) for i in seqs}


def test_weights_by_plain_em(spark, monkeypatch):
    rows = [(i, t, i % 5 == 4) for i, t in enumerate(["a b a b a c", "a b b a", "c a b a b", "b a", "a b a c d e a b"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    for order, chars in ((1, 10**7), (2, 10**7), (3, 10**7), (3, 20), (4, 10**7)):
        monkeypatch.setattr(lm, "CHUNK_CHARS", chars)
        monkeypatch.setattr(lm, "BUCKET_BYTES", chars)
        want = plain(rows, order)
        for r in lm.score(docs, order).collect():
            for got, known in zip((r.score, r.whole_score), want[r.doc_id]):
                assert abs(got - known) < 0.02 * abs(known)


def test_texts_that_repeat_stand_out(spark):
    """A text seen twice in training scores higher a token than one of the same words seen once."""
    random.seed(3)
    some = [" ".join(random.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(200)]
    rows = [(i, t, False) for i, t in enumerate(some + some[:30])]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 200)) + 0.3


def test_odd_rows(spark):
    """Null and repeated ids, ties, and columns with the names of the result."""
    rows = [(None, "a b", False), (None, None, True), (3, "a b", False), (3, "a b", False), (3, "c", True), (4, "a  b\n", False)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, held boolean, score string, chunk int")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(docs).collect()), key=str)
    assert got == sorted([(None, False, 3, 3, 12), (None, True, 1, 1, 12), (3, False, 3, 3, 12), (3, False, 3, 3, 12), (3, True, 2, 1, 12), (4, False, 3, 3, 12)], key=str)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, held boolean")).count() == 0


def test_nothing_to_train_on(spark):
    r = lm.score(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3
