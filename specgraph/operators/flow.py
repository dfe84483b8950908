"""Control flow of a document's graph: depth-first order, edge classes, dominators, loops, walks, communities.

These follow an order node by node, so each flow (column ``flow``: a document, or a weak component of one) is
worked on as a group. Flows are to be of bounded size; components of whole stores come from ``analytics.components``.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import per_group


class Flow:
    """Successors in order, predecessors and roots of one flow."""

    def __init__(self, rows: pd.DataFrame | list[tuple]):
        """rows: src_id, dst_id, pos, kind, which is edge or entry."""
        rows = list(rows[["src_id", "dst_id", "pos", "kind"]].itertuples(index=False, name=None)) if isinstance(rows, pd.DataFrame) else rows
        moves = sorted((a, pos is None, pos or 0, b) for a, b, pos, kind in rows if kind == "edge")
        self.next: dict[str, list[str]] = defaultdict(list)
        self.before: dict[str, list[str]] = defaultdict(list)
        for a, _, _, b in moves:
            self.next[a].append(b)
            self.before[b].append(a)
        self.nodes = sorted({*self.next, *self.before})
        given = sorted(a for a, _, _, kind in rows if kind == "entry")
        self.roots = [r for r in given if r in self.next or r in self.before] or [n for n in self.nodes if not self.before[n]] or self.nodes[:1]

    def forest(self) -> tuple[dict[str, int], dict[str, int], dict[str, str]]:
        """(preorder, postorder, parent), from the roots first, then from what they don't reach."""
        pre: dict[str, int] = {}
        post: dict[str, int] = {}
        parent: dict[str, str] = {}
        for root in [*self.roots, *self.nodes]:
            if root in pre:
                continue
            pre[root] = len(pre)
            stack = [(root, iter(self.next[root]))]
            while stack:
                node, rest = stack[-1]
                child = next((c for c in rest if c not in pre), None)
                if child is None:
                    post[node] = len(post)
                    stack.pop()
                else:
                    pre[child], parent[child] = len(pre), node
                    stack.append((child, iter(self.next[child])))
        return pre, post, parent

    def classes(self) -> list[tuple[str, str, str]]:
        """Every edge as tree, forward, back or cross."""
        pre, post, parent = self.forest()
        out, used = [], set()
        for a in self.nodes:
            for b in self.next[a]:
                if parent.get(b) == a and (a, b) not in used:
                    used.add((a, b))
                    kind = "tree"
                elif pre[b] <= pre[a] and post[b] >= post[a]:
                    kind = "back"
                else:
                    kind = "forward" if pre[a] < pre[b] else "cross"
                out.append((a, b, kind))
        return out

    def dominators(self) -> dict[str, set[str]]:
        """Nodes on every path from the roots to each node that these reach."""
        pre, post, _ = self.forest()
        reach, todo = set(self.roots), list(self.roots)
        while todo:
            for c in self.next[todo.pop()]:
                if c not in reach:
                    reach.add(c)
                    todo.append(c)
        order = sorted(reach, key=lambda n: -post[n])
        dom = {n: ({n} if n in self.roots else set(reach)) for n in order}
        changed = True
        while changed:
            changed = False
            for n in order:
                if n in self.roots:
                    continue
                new = {n} | set.intersection(*[dom[p] for p in self.before[n] if p in reach])
                if new != dom[n]:
                    dom[n], changed = new, True
        return dom

    def loops(self) -> dict[str, set[str]]:
        """Header to body of natural loops: edges back to a dominator, merged by header."""
        dom = self.dominators()
        out: dict[str, set[str]] = {}
        for a, b, _ in self.classes():
            if b in dom.get(a, ()):
                body, todo = {b, a}, [a] if a != b else []
                while todo:
                    for p in self.before[todo.pop()]:
                        if p not in body and p in dom:
                            body.add(p)
                            todo.append(p)
                out.setdefault(b, set()).update(body)
        return out

    def walk(self) -> list[tuple[str, str, int]]:
        """(root, node, step): breadth-first from every root."""
        out = []
        for root in self.roots:
            seen, line = {root}, [root]
            for n in line:
                for c in self.next[n]:
                    if c not in seen:
                        seen.add(c)
                        line.append(c)
            out += [(root, n, k) for k, n in enumerate(line)]
        return out


def _grouped(edges: DataFrame, entries: DataFrame | None, each, schema: str) -> DataFrame:
    """each(Flow) for every flow; edges have flow, src_id, dst_id, pos, entries flow and node_id."""
    rows = edges.select("flow", "src_id", "dst_id", "pos", F.lit("edge").alias("kind"))
    if entries is not None:
        rows = rows.unionByName(entries.select("flow", F.col("node_id").alias("src_id"), F.lit(None).cast("string").alias("dst_id"), F.lit(0).alias("pos"), F.lit("entry").alias("kind")))
    return per_group(rows, "flow", lambda flow, group: [(flow, *r) for r in each(Flow([g[1:] for g in group]))], f"flow {dict(edges.dtypes)['flow']}, {schema}")


def depth_first(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(flow, node_id, preorder, postorder, parent)."""
    def each(f: Flow):
        pre, post, parent = f.forest()
        return [(n, pre[n], post[n], parent.get(n)) for n in f.nodes]

    return _grouped(edges, entries, each, "node_id string, preorder int, postorder int, parent string")


def edge_classes(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(flow, src_id, dst_id, class)."""
    return _grouped(edges, entries, lambda f: f.classes(), "src_id string, dst_id string, class string")


def dominators(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(flow, node_id, dominator): every dominator of every node that the entries reach."""
    return _grouped(edges, entries, lambda f: [(n, d) for n, ds in f.dominators().items() for d in sorted(ds)], "node_id string, dominator string")


def loops(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(flow, header, node_id): members of natural loops."""
    return _grouped(edges, entries, lambda f: [(h, n) for h, b in f.loops().items() for n in sorted(b)], "header string, node_id string")


def walks(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(flow, entry, node_id, step): nodes in the order in which they are met from each entry."""
    return _grouped(edges, entries, lambda f: f.walk(), "entry string, node_id string, step int")


def branches_and_merges(edges: DataFrame) -> DataFrame:
    """(flow, node_id, kind, n): nodes with several successors or predecessors."""
    e = edges.select("flow", "src_id", "dst_id").distinct()
    out = e.groupBy("flow", F.col("src_id").alias("node_id")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("kind", F.lit("branch"))
    into = e.groupBy("flow", F.col("dst_id").alias("node_id")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("kind", F.lit("merge"))
    return out.unionByName(into).select("flow", "node_id", "kind", "n")


def louvain(nodes: list[str], pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Communities of an undirected graph by greedy modularity with aggregation; nodes are visited by id, so that the result is fixed."""
    weight: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b in {tuple(sorted(p)) for p in pairs}:
        weight[a][b] = weight[b][a] = 1.0
    member = {n: n for n in nodes}
    while True:
        degree = {n: sum(w.values()) + w.get(n, 0.0) for n, w in weight.items()}
        total = sum(degree.values()) or 1.0
        home = {n: n for n in weight}
        mass = dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in sorted(weight):
                mass[home[n]] -= degree[n]
                link: dict[str, float] = defaultdict(float)
                for m, w in weight[n].items():
                    if m != n:
                        link[home[m]] += w
                gain = lambda c: link.get(c, 0.0) - mass.get(c, 0.0) * degree[n] / total  # noqa: B023, E731
                best = max(sorted({home[n], *link}), key=lambda c: (round(gain(c), 12), c == home[n]))
                moved |= best != home[n]
                any_move |= best != home[n]
                home[n] = best
                mass[best] = mass.get(best, 0.0) + degree[n]
        member = {n: home[c] for n, c in member.items()}
        if not any_move:
            names = {c: i for i, c in enumerate(sorted(set(member.values())))}
            return {n: names[c] for n, c in member.items()}
        merged: dict[str, dict[str, float]] = {c: defaultdict(float) for c in set(home.values())}
        for a, row in weight.items():
            for b, w in row.items():
                merged[home[a]][home[b]] += w if a != b or home[a] != home[b] else w
        weight = {c: {d: (w / 2 if d == c and c in row else w) for d, w in row.items()} for c, row in merged.items()}


def communities(edges: DataFrame) -> DataFrame:
    """(flow, node_id, community) of each component (column flow) of an undirected graph."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        got = louvain(sorted({*frame["src_id"], *frame["dst_id"]}), list(zip(frame["src_id"], frame["dst_id"])))
        return pd.DataFrame([(key[0], n, c) for n, c in got.items()], columns=["flow", "node_id", "community"])

    return edges.select("flow", "src_id", "dst_id").filter("src_id != dst_id").groupBy("flow").applyInPandas(run, f"flow {dict(edges.dtypes)['flow']}, node_id string, community int")


def level_groups(communities_: DataFrame) -> DataFrame:
    """(community, level_group): consecutive communities in max(2, ceil(sqrt(n))) groups."""
    from pyspark.sql.window import Window as W

    c = communities_.select("community").distinct()
    n = c.agg(F.count("*").alias("n"))
    groups = F.greatest(F.lit(2), F.ceil(F.sqrt("n")))
    r = c.withColumn("rn", F.row_number().over(W.orderBy("community")) - 1).crossJoin(F.broadcast(n))  # a row a community, one row
    return r.select("community", F.floor(F.col("rn") / F.ceil(F.col("n") / groups)).cast("int").alias("level_group"))
