"""Queries over all heads or nodes: against brute force and against their SQL."""

import duckdb

from thalweg import catalog
from thalweg.plans import views

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def by_sql(name, *cols):
    c = duckdb.connect()
    for t in "customer orders lineitem part supplier nation region events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(c.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())


def test_profiles_from_every_head(spark):
    seg = {r.cat: (r.tostream, r.len) for r in views.segments(spark, SF).collect()}
    want = []
    for head in set(seg) - {t for t, _ in seg.values()}:
        path = [head]
        while seg[path[-1]][0]:
            path.append(seg[path[-1]][0])
        want += [(head, i, c, seg[c][1], sum(seg[x][1] for x in path[i:])) for i, c in enumerate(path)]
    cols = ("head", "ord", "cat", "len", "s")
    assert rows(catalog.QUERIES["w7_downstream_profile"](spark, SF), *cols) == sorted(want) == by_sql("w7_downstream_profile", *cols)


def test_grid_walks_from_every_node(spark):
    n = {r.node: (r.recv, r.r, r.c) for r in catalog.QUERIES["r2_d8_receivers"](spark, SF).collect()}
    walks, sets = {}, {k: {k} for k in n}
    for k in n:
        walks[k] = [k]
        while n[walks[k][-1]][0] != walks[k][-1]:
            walks[k].append(n[walks[k][-1]][0])
        for x in walks[k]:
            sets[x].add(k)
    assert max(map(len, walks.values())) > 10
    assert rows(catalog.QUERIES["r19_trace_down"](spark, SF), "start", "i", "node") == sorted((k, i, x) for k, w in walks.items() for i, x in enumerate(w))
    assert rows(catalog.QUERIES["r20_upslope_sets"](spark, SF), "top", "node") == sorted((t, x) for t, s in sets.items() for x in s)
    rims = []
    for t, s in sets.items():
        at = {n[x][1:] for x in s}
        for x in s:
            _, r, c = n[x]
            if any((r + a, c + b) not in at for a in (-1, 0, 1) for b in (-1, 0, 1)):
                rims.append((t, x, round(((r - n[t][1]) ** 2 + (c - n[t][2]) ** 2) ** 0.5, 6)))
    assert rows(catalog.QUERIES["r21_rims"](spark, SF), "top", "node", "linear") == sorted(rims)
    for name, cols in (("r19_trace_down", ("start", "i", "node")), ("r20_upslope_sets", ("top", "node")), ("r21_rims", ("top", "node", "linear"))):
        assert rows(catalog.QUERIES[name](spark, SF), *cols) == by_sql(name, *cols)
