"""Registered queries over whole tables: results that a cut in the query would change."""

import duckdb

from terrane.plans.registry import QUERIES


def save(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_components_of_all_edges(spark, sf_dir):
    rows = duckdb.sql(f"SELECT DISTINCT l_orderkey, l_suppkey + 1000000000 FROM '{sf_dir}/lineitem.parquet'").fetchall()
    root = {x: x for e in rows for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in rows:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in QUERIES["connected_components"](spark, sf_dir).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_high_ids(spark, tmp_path):
    save(spark, tmp_path, "lineitem", [(500, 1), (500, 2), (600, 2), (700, 5), (1, 7)], "l_orderkey long, l_suppkey long")
    got = {r["id"]: r["component"] for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    k = 1000000000
    assert got == {500: 500, 600: 500, k + 1: 500, k + 2: 500, 700: 700, k + 5: 700, 1: 1, k + 7: 1}


def hops_and_owners(cells):
    """Breadth first over all cells; the rest go to the seed nearest by place, with hops -1."""
    level = {c: c[0] * 1000 + c[1] for c in cells if (c[0] + c[1]) % 23 == 0}
    seeds, out, hops = dict(level), {}, 0
    while level:
        out |= {c: (hops, o) for c, o in level.items()}
        new = {}
        for (i, j), o in level.items():
            for n in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if n in cells and n not in out:
                    new[n] = min(o, new.get(n, o))
        level, hops = new, hops + 1
    for i, j in cells - set(out):
        out[i, j] = (-1, min(((i - a) ** 2 + (j - b) ** 2, o) for (a, b), o in seeds.items())[1])
    return out


def test_owners_of_far_and_unreached_cells(spark, tmp_path):
    # cells about the seed (1, 22), and three apart from it
    cells = {(1, 22)} | {(1, j) for j in range(23, 43) if (7 + j) % 4} | {(2, j) for j in range(22, 44) if (14 + j) % 4} | {(30, 30), (40, 11), (40, 12)}
    cells = {(i, j) for i, j in cells if (i * 7 + j) % 4}
    save(spark, tmp_path, "part", [(i, f"Brand#{j}") for i, j in sorted(cells)], "p_size int, p_brand string")
    got = {(r["i"], r["j"]): (r["hops"], r["owner"]) for r in QUERIES["bfs_owner_hops"](spark, str(tmp_path)).collect()}
    assert got == hops_and_owners(cells)
    assert -1 in {h for h, _ in got.values()}


def test_owners_of_the_whole_lattice(spark):
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT DISTINCT p_size, CAST(substr(p_brand, 7) AS INT) FROM '{d}/part.parquet'").fetchall()
    cells = {(i, j) for i, j in rows if (i * 7 + j) % 4}
    got = {(r["i"], r["j"]): (r["hops"], r["owner"]) for r in QUERIES["bfs_owner_hops"](spark, d).collect()}
    assert got == hops_and_owners(cells)
    assert max(h for h, _ in got.values()) > 12 and -1 in {h for h, _ in got.values()}


def test_nearest_of_all_suppliers(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    want = dict(duckdb.sql(f"""SELECT c_custkey, arg_min(s_suppkey, struct_pack(d := pow(c_acctbal - s_acctbal, 2), i := s_suppkey))
        FROM '{d}/customer.parquet', '{d}/supplier.parquet' GROUP BY 1""").fetchall())
    got = {r["c_custkey"]: r["nearest_id"] for r in QUERIES["nearest_reference"](spark, d).collect()}
    assert got == want and max(got.values()) > 50
    save(spark, tmp_path, "customer", [(1, 5.0), (2, None), (3, 100.0), (4, -9.0), (5, 7.0)], "c_custkey long, c_acctbal double")
    save(spark, tmp_path, "supplier", [(90, 4.0), (80, 6.0), (70, 6.0), (60, None), (10, 8.0)], "s_suppkey long, s_acctbal double")
    got = {r["c_custkey"]: r["nearest_id"] for r in QUERIES["nearest_reference"](spark, str(tmp_path)).collect()}
    assert got == {1: 70, 2: None, 3: 10, 4: 90, 5: 10}


def test_strides_over_all_events(spark):
    d = "/root/testdata/sf0.01"
    ids = [r[0] for r in duckdb.sql(f"SELECT event_id FROM '{d}/events.parquet' ORDER BY ts").fetchall()]
    want = {ids[round(i * (len(ids) - 1) / 99)] for i in range(100)}
    got = [r["event_id"] for r in QUERIES["strided_cap"](spark, d).collect()]
    assert len(got) == 100 and set(got) == want


def test_vectors_that_differ_in_the_last_component(spark, tmp_path):
    rows = [(i, [float(v)] * 63 + [last]) for i, (v, last) in enumerate([(0, 0.0), (0, 9.0), (9, 0.0), (9, 9.0), (9, 9.0)])]
    save(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in QUERIES["distinct_quantized_vectors"](spark, str(tmp_path)).collect()] == [(5, 4)]
