import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockframe.operators.ingest import diagnose, rejects, strict_load
from blockframe.operators.skew import fragment_replicate_join, key_statistics
from blockframe.plans.balance import make_plan, pack, route
from blockframe.plans.graph import contract
from blockframe.plans.index import dense_index

SCHEMA = "line_id bigint, file_name string, line string"


def parse(line):
    """Plain reading of a line: its fields, or None if it is badly quoted."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"', re.S).match(line, i)
            if not m:
                return None
            out.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            m = re.compile(r'[^",]*').match(line, i)
            out.append(m[0])
            i = m.end()
        if i == len(line):
            return out
        if line[i] != ",":
            return None
        i += 1


def reasons(line):
    fields = parse(line or "")
    if fields is None:
        return ["quoting"]
    if len(fields) != 4:
        return ["columns"]
    c2, c3 = (f.strip(" \t\r") for f in fields[2:])
    bad = [] if c2 == "" or (re.fullmatch("[0-9]+", c2) and 1 <= int(c2) <= 5) else ["c2"]
    return bad + ([] if re.fullmatch("[0-9]+", c3) and 946684800 <= int(c3) <= 1893455999 else ["c3"])


LINES = [
    "1,2,3,1300000000", '"1","2","3","1300000000"', "1,2,,1300000000", "1,2, 03\t,1300000000\r", "", None, "   ", "1,2,3", "1,2,3,4,5", '"', '""', '"""', '""""', "a\"b,1,3,1300000000",
    '"a""b",x,3,1300000000', '"a,b",x,3,1300000000', '"a" ,2,3,1300000000', ' "a",2,3,1300000000', "1,2,6,1300000000", "1,2,0,946684799", "1,2,5,946684800", "1,2,5,1893455999", "1,2,5,1893455999.0",
    "1,2,-1,1893456000", "1,2,+3,1300000000", "1,2,٣,1300000000", "1,2,3," + "9" * 400, "1,2,3,00001300000000", "x" * 100_000 + ",2,3,1300000000", '"' + '""' * 50_000 + '",2,3,1300000000', "1,2,3,1300000000\n",
    '1,"2\n2",3,1300000000', '1,"",3,1300000000', "99999999999,-7,3,1300000000", "1,\u0001a,3,1300000000", '"\u0001b,",2,"3",1300000000', '1,2,3,"1300000000', '1,2,3,1300000000"', ",,,", '"1"2,2,3,1300000000',
]


def check(spark, lines):
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(lines)], SCHEMA)
    want = {i: reasons(v) for i, v in enumerate(lines)}
    assert {r.line_id: r.reasons for r in rejects(df).collect()} == {i: r for i, r in want.items() if r}
    good = {r.line_id: r for r in strict_load(df).collect()}
    assert set(good) == {i for i, r in want.items() if not r}
    return good


def test_lines(spark):
    good = check(spark, LINES)
    assert (good[0].c0, good[0].c1, good[0].c2, good[0].c3) == (1, 2, 3, 1300000000)
    assert good[2].c2 is None and good[3].c2 == 3
    at = LINES.index("99999999999,-7,3,1300000000")
    assert good[at].c0 is None and good[at].c1 == -7


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='"",1 \ta\r', max_size=14), min_size=30, max_size=60))
def test_any_line(spark, lines):
    check(spark, [x + ",3,1300000000" if i % 2 else x for i, x in enumerate(lines)])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert strict_load(df).count() == rejects(df).count() == diagnose(df).count() == 0
    df = spark.createDataFrame([(1, "f", "1,2,9,1300000000", "x", 5)], SCHEMA + ", reasons string, c2 int")
    assert rejects(df).first().reasons == ["c2"]


RATINGS = "c0 int, c1 int, c2 int, c3 bigint"


def brute(rows, share=0.02):
    out = {}
    for k, name in ((0, "c0"), (1, "c1")):
        for key in {r[k] for r in rows} - {None}:
            own = [r for r in rows if r[k] == key]
            v, t = [r[2] for r in own if r[2] is not None], [r[3] for r in own if r[3] is not None]
            out[name, key] = (len(own), round(sum(v) / len(v), 9) if v else None, max(t) if t else None, len(own) >= share * len(rows))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_key_statistics(spark, hot):
    r = random.Random(1)
    pick = lambda n: 7 if r.random() < hot else r.choice([*range(n), None])
    rows = [(pick(200), pick(30), r.choice([None, 1, 2, 5]), r.choice([None, 0, 9, 13])) for _ in range(3000)]
    df = spark.createDataFrame(rows, RATINGS).withColumn("field", F.lit("x")).withColumn("n", F.lit(1)).repartition(6)
    got = {(x.field, x.key_value): (x.n_rows, None if x.mean_value is None else round(x.mean_value, 9), x.last_time, x.is_heavy) for x in key_statistics(df, ["c0", "c1"], "c2", "c3", tasks=5).collect()}
    assert got == brute(rows)


def test_key_statistics_of_nothing(spark):
    assert key_statistics(spark.createDataFrame([], RATINGS), ["c0", "c1"], "c2", "c3").count() == 0
    df = spark.createDataFrame([(None, None, None, None)] * 3, RATINGS)
    assert key_statistics(df, ["c0", "c1"], "c2", "c3").count() == 0


def test_hot_key_is_spread(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(4)
    plan = make_plan(df, ["k"], tasks=8)
    assert len(plan.heavy[(1,)]) > 4 and max(plan.loads) < 1.5 * 10_000 / 8
    routed = route(df, ["k"], plan)
    sizes = [r.n for r in routed.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 1.5 * 10_000 / 8
    small = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (None, "d")], "k bigint, name string")
    for how in ("inner", "left"):
        got = fragment_replicate_join(df, small, ["k"], how)
        assert sorted(map(tuple, got.select("k", "v", "name").collect()), key=repr) == sorted(map(tuple, df.join(small, "k", how).select("k", "v", "name").collect()), key=repr)
    with pytest.raises(ValueError):
        fragment_replicate_join(df, small.withColumn("v", F.lit(1)), ["k"])


def test_pack():
    at, loads = pack([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2)
    assert sorted(loads) == [7, 8] and set(at) == set("abcd")


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in contract(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert contract(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_dense_index(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v")).repartition(7)
    got = dense_index(df, ["v"]).collect()
    assert all(r.row_idx == r.v for r in got) and len(got) == 500
    assert dense_index(spark.createDataFrame([], "v int"), ["v"]).count() == 0
