"""DataFrame operators over nodes, edges, items, blocks, chunks and test cases."""
