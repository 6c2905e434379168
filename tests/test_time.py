"""Stream state, late arrivals, sessions, as-of and overlap joins, lattices, differences, pages and the query log."""

import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.operators import along, changes, ingest, intervals, lattice, multiset, numbering, paging, sessions, stats
from marketlens.plans.registry import Tables
from marketlens.sources import history, scratch
from marketlens.streaming import arrivals
from marketlens.streaming.ingest import stream_ingest, table_so_far
from marketlens.streaming.state import KeyState

SMALL = "/root/testdata/sf0.001"
BEGIN = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.fixture()
def many_ranges(spark):
    """Ranges stay as many as shuffles have partitions, however small they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def at(seconds):
    return None if seconds is None else BEGIN + timedelta(seconds=seconds)


# --- state of the stream -----------------------------------------------------


def test_ten_micro_batches_with_state(spark, tmp_path):
    """Ten portions, the stream stopped and started between them, and its last batch run twice."""
    rng = random.Random(9)
    links = spark.createDataFrame(
        [(i, rng.choice([f"Name {rng.randrange(80)}", f" name {rng.randrange(80)} ", None]), rng.choice(["l", "l", None])) for i in range(300)],
        "pos int, nome string, link string",
    )
    known = spark.createDataFrame([(i, f"NAME {i}", "old", BEGIN) for i in range(0, 30, 3)], "id int, categorias string, links string, created_at timestamp")
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    state = KeyState(out, ingest.CATEGORY_KEY, known.schema, buckets=4, merge_after=4)

    def insert(before, batch):
        return ingest.insert_new_categories(before, batch, "2024-01-31")

    def parse(batch):
        return batch.withColumnRenamed("nome", "categorias")

    def run():
        stream_ingest(
            spark, source, out, checkpoint, links.schema, known, insert, max_files_per_trigger=1, state=state, parse=parse
        ).awaitTermination()

    for portion in range(10):
        links.where(f"pos >= {portion * 30} AND pos < {portion * 30 + 30}").coalesce(1).write.mode("append").parquet(source)
        if portion in (4, 9):
            run()
    expected = rows(known.unionByName(insert(known, links)))
    assert rows(table_so_far(spark, out, known.schema)) == expected and len(expected) > 60
    assert len(list((tmp_path / "out" / "_ingest_keys" / "complete").glob("before-*"))) == 3
    for name in ("9", ".9.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    run()
    assert rows(table_so_far(spark, out, known.schema)) == expected


def test_a_micro_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    schema = "id long, categorias string, links string"
    table = spark.createDataFrame([(i, f" Name {i}", "x") for i in range(200)] + [(500, None, "x")], schema)
    state = KeyState(str(tmp_path / "out"), ingest.CATEGORY_KEY, table.schema, buckets=16)
    state.start(table, 0)
    state.add(spark.createDataFrame([(501, "name 200", "x")], schema), 0)
    batch = spark.createDataFrame([("NAME 7 ",), ("name 200",), (None,)], "categorias string")
    known = state.known(batch, 1)
    found = {(r.id, r.categorias) for r in known.collect()}
    assert {(7, "name 7"), (501, "name 200"), (501, None)} <= found and len(found) < 100
    text = plan(known)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET)", text) and "bucket" in text
    assert all("_ingest_keys" in path for path in known.inputFiles())
    assert known.schema.names == table.schema.names


# --- late arrivals -----------------------------------------------------------


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    rng = random.Random(3)
    schema = "id long, ts timestamp, v string"
    portions, hour = [], 3600
    for number in range(6):
        portion = [(rng.randrange(60), at(hour * max(0, number * 10 + rng.randrange(-14, 10))), rng.choice("ab")) for _ in range(30)]
        portions.append(portion + [(None, at(number * 10 * hour), "no key"), (None, at(number * 10 * hour), "no key"), (number, None, "no time")])
    kept, late, top = [], [], None
    for portion in portions:
        mark = BEGIN - timedelta(days=9999) if top is None else top - timedelta(seconds=5 * hour)
        timely = [r for r in portion if r[1] is not None and r[1] >= mark]
        late += [r for r in portion if r[1] is None or r[1] < mark]
        known = {r[0] for r in kept if r[1] >= mark}
        firsts = {}
        for r in sorted((r for r in timely if r[0] is not None), key=lambda r: (r[1], r[2])):
            firsts.setdefault(r[0], r)
        kept += [r for r in firsts.values() if r[0] not in known] + [r for r in timely if r[0] is None]
        top = max([r[1] for r in portion if r[1] is not None] + ([top] if top else []))
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    kind = spark.createDataFrame([], schema).schema

    def run():
        arrivals.stream_arrivals(spark, source, out, checkpoint, kind, "id", "ts", 5 * hour, max_files_per_trigger=1).awaitTermination()

    for number, portion in enumerate(portions):
        spark.createDataFrame(portion, schema).coalesce(1).write.mode("append").parquet(source)
        if number in (2, 5):
            run()
    for name in ("5", ".5.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    run()
    assert len(late) > 5 and len(kept) < sum(map(len, portions)) - len(late)
    assert rows(arrivals.arrived(spark, out, kind)) == sorted(kept, key=repr)
    assert rows(arrivals.arrived(spark, out, kind, arrivals.LATE)) == sorted(late, key=repr)


# --- sessions ----------------------------------------------------------------


def plain_sessions(data, gap):
    found = []
    for key in {k for k, _, _ in data}:
        current = None
        for second, value in sorted((s, v) for k, s, v in data if k == key and s is not None):
            if current is None or second - current[2] >= gap:
                current = [key, second, second, 0, 0]
                found.append(current)
            current[2], current[3], current[4] = second, current[3] + 1, current[4] + value
    return sorted(((k, at(a), at(b), n, v) for k, a, b, n, v in found), key=repr)


@pytest.fixture(scope="module")
def clicks():
    rng = random.Random(1)
    # A third of the rows under one key; another whose session goes on for many spans; rows exactly a gap apart.
    data = [("hot", rng.randrange(400_000), 1) for _ in range(1500)] + [("long", i * 900, 2) for i in range(300)]
    data += [(f"u{rng.randrange(40)}", rng.randrange(400_000), rng.randrange(3)) for _ in range(1500)]
    return data + [("edge", 0, 1), ("edge", 1000, 1), ("edge", 1999, 1), ("edge", 2998, 1), (None, 5, 1), (None, 6, 1), ("none", None, 1)]


def test_sessions(spark, clicks):
    frame = spark.createDataFrame([(k, at(s), v) for k, s, v in clicks], "key string, ts timestamp, v int").repartition(6)
    for span in (1000, 7200, 10**7):
        got = sessions.sessions(frame, ["key"], "ts", 1000, {"total": F.col("v")}, span=span)
        assert rows(got) == plain_sessions(clicks, 1000)
    assert sessions.sessions(frame.limit(0), ["key"], "ts", 1000).count() == 0
    # What is sorted for one key alone are sessions at the borders of spans.
    assert plan(got).count("hashpartitioning(key#") >= 1
    with pytest.raises(ValueError):
        sessions.sessions(frame, ["key"], "ts", 1000, span=10)


def test_stream_sessions_equal_the_table_s(spark, clicks, tmp_path):
    frame = spark.createDataFrame([(k, at(s), v) for k, s, v in clicks if s is not None], "key string, ts timestamp, v int")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = sessions.stream_sessions(stream, ["key"], "ts", 1000, "30 days", {"total": F.col("v")})
    name = "sessions_of_a_stream"
    made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table(name)) == rows(sessions.sessions(frame, ["key"], "ts", 1000, {"total": F.col("v")}))


# --- along the order ---------------------------------------------------------


def test_asof_join(spark, many_ranges):
    rng = random.Random(4)

    def key():
        return "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])

    left = [(i, key(), at(rng.randrange(3000))) for i in range(1500)] + [(9000, "a", None), (9001, "unseen", at(5)), (9002, "a", at(-5))]
    left += left[:3]
    right = [(i, key(), at(rng.randrange(3000)), f"v{i}") for i in range(600)] + [(7000, "a", None, "never"), (7001, "hot", at(7), None)]
    mine = spark.createDataFrame(left, "id int, k string, t timestamp").repartition(5)
    theirs = spark.createDataFrame(right, "rid int, k string, rt timestamp, v string").repartition(3)
    expected = []
    for i, k, t in left:
        before = [(rt, rid, v) for rid, rk, rt, v in right if rk == k and rt is not None and t is not None and rt <= t]
        rt, rid, v = max(before, key=lambda r: r[:2]) if before else (None, None, None)
        expected.append((i, k, t, rid, v))
    got = along.asof_join(mine, theirs, ["k"], "t", "rt", ["rid", "v"], tie="rid")
    assert rows(got) == sorted(expected, key=repr)
    # The hot key is divided: ranges are about even.
    sizes = [r["count"] for r in along.in_order(mine.select("k", "t"), [F.col("k"), F.col("t")]).groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(left) / 3
    assert along.asof_join(mine, theirs.limit(0), ["k"], "t", "rt", ["v"], tie="rid").where("v IS NOT NULL").count() == 0
    assert along.asof_join(mine.limit(0), theirs, ["k"], "t", "rt", ["v"], tie="rid").count() == 0


def test_overlaps_and_concurrency(spark, many_ranges):
    rng = random.Random(5)
    data = []
    for i in range(400):
        begin = rng.randrange(5000)
        data.append((i, at(begin), at(begin + rng.choice([0, 1, 5, 30, 900]))))
    data += [(1000, at(0), at(6000)), (1001, at(9), at(5)), (1002, None, at(5)), (1003, at(5), None), (1004, at(30), at(31)), (1005, at(30), at(31))]
    frame = spark.createDataFrame(data, "id int, start timestamp, end timestamp").repartition(4)
    whole = [r for r in data if r[1] is not None and r[2] is not None and r[1] < r[2]]
    expected = Counter((a[0], b[0]) for a in whole for b in whole if a[1] < b[2] and b[1] < a[2])
    found = intervals.overlaps(frame, frame)
    assert Counter((r["left"].id, r["right"].id) for r in found.collect()) == expected
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    running = {a[0]: sum(b[1] <= a[1] < b[2] for b in whole) for a in whole}
    assert {r.id: r.running for r in intervals.concurrency(frame).collect()} == running
    assert intervals.overlaps(frame.limit(0), frame).count() == 0 and intervals.concurrency(frame.limit(0)).count() == 0


def spans(spark, data, parts=4):
    return spark.createDataFrame(data, "id int, start timestamp, end timestamp").repartition(parts)


def test_overlaps_in_small_blocks(spark, many_ranges, monkeypatch):
    """Blocks, slices and ties: pairs of two tables, and pairs within one, each once."""
    monkeypatch.setattr(intervals, "BLOCK", 7)
    monkeypatch.setattr(intervals, "SLICE_PAIRS", 20)
    monkeypatch.setattr(intervals, "TASK_PAIRS", 500)
    rng = random.Random(8)

    def some(n):
        begins = [rng.randrange(300) for _ in range(n)]
        data = [(rng.choice([i, i, None, 3]), at(b), at(rng.choice([b, b + 1, b + rng.randrange(40), 350]))) for i, b in enumerate(begins)]
        return data + data[:9] + [(5000, at(7), at(7)), (5001, at(9), at(2)), (5002, None, at(3)), (5003, at(3), None)]

    mine, theirs = some(110), some(70)

    def meet(a, b):
        return None not in a[1:] + b[1:] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]

    found = intervals.overlaps(spans(spark, mine), spans(spark, theirs).withColumnRenamed("id", "key"))
    assert found.schema["right"].dataType.names == ["key", "start", "end"]
    expected = Counter((a, b) for a in mine for b in theirs if meet(a, b))
    assert Counter((tuple(r.left), tuple(r.right)) for r in found.collect()) == expected
    within = intervals.overlaps(spans(spark, mine)).collect()
    assert all(r.left.start <= r.right.start for r in within)
    pairs = Counter(frozenset(Counter([a, b]).items()) for i, a in enumerate(mine) for b in mine[:i] if meet(a, b))
    assert Counter(frozenset(Counter([tuple(r.left), tuple(r.right)]).items()) for r in within) == pairs


def test_overlaps_of_one_moment_are_divided(spark, many_ranges, monkeypatch):
    """Long intervals with one end that meet many short ones at one moment: no task makes most of the pairs."""
    monkeypatch.setattr(intervals, "SLICE_PAIRS", 1000, raising=False)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        long = spans(spark, [(i, at(i), at(90_000)) for i in range(400)])
        short = spans(spark, [(i, at(80_000), at(80_001)) for i in range(200)])
        made = [r["count"] for r in intervals.overlaps(long, short).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(made) == 400 * 200 and max(made) < sum(made) / 2


@pytest.mark.parametrize("block,marks", [(64, 1 << 18), (24, 5)])
def test_overlaps_within_steps(spark, many_ranges, monkeypatch, block, marks):
    """Few starts are known to all tasks, and many rows start at one moment: what lies between two known starts is told apart."""
    monkeypatch.setattr(intervals, "BLOCK", block)
    monkeypatch.setattr(intervals, "MAX_MARKS", marks, raising=False)
    rng = random.Random(11)

    def some(n):
        begins = [rng.choice([100, rng.randrange(400)]) for _ in range(n)]
        return [(i, at(b), at(b + rng.choice([1, 1, 2, 25, 300]))) for i, b in enumerate(begins)]

    mine, theirs = some(230), some(170)
    found = intervals.overlaps(spans(spark, mine), spans(spark, theirs))
    assert Counter((r.left.id, r.right.id) for r in found.collect()) == Counter((a[0], b[0]) for a in mine for b in theirs if a[1] < b[2] and b[1] < a[2])
    within = Counter(frozenset([r.left.id, r.right.id]) for r in intervals.overlaps(spans(spark, mine)).collect())
    assert within == Counter(frozenset([a[0], b[0]]) for i, a in enumerate(mine) for b in mine[:i] if a[1] < b[2] and b[1] < a[2])


def moved(frame):
    """Rows that the exchanges of a frame write when it runs."""
    query = frame._jdf.queryExecution()
    query.toRdd().count()

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return below(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        written, children = node.metrics().get("shuffleRecordsWritten"), node.children()
        return (written.get().value() if written.isDefined() else 0) + sum(below(children.apply(i)) for i in range(children.size()))

    return below(query.executedPlan())


def test_overlaps_move_and_write_rows_not_pairs(spark, many_ranges, monkeypatch):
    """Every interval overlaps every other: what is written and moved for the pairs grows with the rows alone."""
    monkeypatch.setattr(intervals, "BLOCK", 7)
    written = []

    def recorded(frame, real=scratch.materialise):
        written.append(real(frame))
        return written[-1]

    for module in (along, intervals, numbering):
        monkeypatch.setattr(module, "materialise", recorded, raising=False)
    n = 200
    pairs = intervals.overlaps(spans(spark, [(i, at(i), at(10_000)) for i in range(n)]))
    assert moved(pairs) < 6 * n
    assert sum(frame.count() for frame in written) < 3 * n
    assert pairs.count() == n * (n - 1) // 2


# --- levels and copies -------------------------------------------------------


def test_lattice(spark):
    data = [("a", 1, Decimal("1.10")), ("a", 2, None), ("b", None, Decimal("2.00")), (None, 1, Decimal("0.01")), ("a", 1, Decimal("5.00"))]
    frame = spark.createDataFrame(data, "x string, y int, v decimal(10,2)")
    got = lattice.lattice(frame, ["x", "y"], {"v": F.col("v")}, lattice.rollup(["x", "y"]))
    assert "Expand" not in plan(got)
    expected = []
    for level in (("x", "y"), ("x",), ()):
        groups = {}
        for x, y, v in data:
            groups.setdefault((x if "x" in level else None, y if "y" in level else None), []).append(v)
        for (x, y), values in groups.items():
            given = [v for v in values if v is not None]
            expected.append((",".join(level), x, y, len(values), len(given), sum(given) if given else None, float(sum(given)) / len(given) if given else None))
    assert Counter((r.level, r.x, r.y, r.rows, r.v_n, r.v_sum, r.v_mean) for r in got.collect()) == Counter(expected)
    assert lattice.cube(["x", "y"]) == [("x", "y"), ("x",), ("y",), ()]


def test_multisets(spark, monkeypatch):
    monkeypatch.setattr(multiset, "COPIES", 3)
    left = [(1, None)] * 11 + [(2, "x")] * 2 + [(3, "y")] + [(None, None)] * 4
    right = [(1, None)] * 4 + [(2, "x")] * 5 + [(None, None)] * 4 + [(4, "z")]
    a, b = (spark.createDataFrame(data, "i int, s string").repartition(3) for data in (left, right))
    assert Counter(map(tuple, multiset.except_all(a, b).collect())) == Counter(left) - Counter(right)
    assert Counter(map(tuple, multiset.intersect_all(a, b).collect())) == Counter(left) & Counter(right)
    with pytest.raises(ValueError):
        multiset.except_all(a, b.withColumnRenamed("s", "t"))


# --- pages -------------------------------------------------------------------


def test_pages_are_found_without_writing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(paging, "FEW", 40)
    monkeypatch.setattr(paging, "with_position", None)
    rng = random.Random(6)
    # Half of the rows share one price, some have none.
    data = [(i, Decimal("5.00") if rng.random() < 0.5 else None if rng.random() < 0.1 else Decimal(rng.randrange(900)) / 100) for i in range(2000)]
    rng.shuffle(data)
    spark.createDataFrame(data, "id long, price decimal(10,2)").repartition(4).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    for direction in ("asc", "desc"):
        sign = 1 if direction == "asc" else -1
        ordered = sorted(data, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
        for number in (1, 2, 9, 15, 20, 34, 35, 100, 101):
            found = paging.page_ordered(frame, number, 20, "price", direction)
            assert [(r.id, r.price) for r in found.collect()] == ordered[(number - 1) * 20 : number * 20], (direction, number)
    page = paging.page(frame, 50, 20)
    assert [r.id for r in page.collect()] == list(range(980, 1000))
    assert re.search(r"PushedFilters: \[[^\]]*(LessThan|GreaterThan)", plan(page))
    assert paging.page(frame, 1000, 20).collect() == [] and paging.page(frame.limit(0), 1, 20).collect() == []


def test_text_keys_are_paged_too(spark):
    frame = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "id string")
    assert [r.id for r in paging.page(frame, 3, 10).collect()] == [f"k{i:03d}" for i in range(20, 30)]


# --- log, patches, listings --------------------------------------------------


def test_queries_are_logged_and_the_log_is_trimmed(spark, tmp_path):
    log = history.QueryLog(spark, str(tmp_path / "log"), keep=4)
    assert log.entries().count() == 0
    frames = {"numbers": spark.range(7)}
    assert history.run_logged(spark, frames, "SELECT id FROM numbers WHERE id > 2;", log).count() == 4
    with pytest.raises(Exception):
        history.run_logged(spark, frames, "SELECT nothing FROM numbers", log)
    with pytest.raises(Exception):
        history.run_logged(spark, frames, "SELECT raise_error('late') FROM numbers", log)
    first = log.entries().orderBy("id").collect()
    assert [(r.id, r.status, r.result_count) for r in first] == [(1, "success", 4), (2, "error", 0), (3, "error", 0)]
    assert "nothing" in first[1].error and "late" in first[2].error and all(r.execution_time > 0 and r.ts is not None for r in first)
    for number in range(4):
        log.append({"ts": BEGIN, "query": f"q{number}", "execution_time": 0.1, "result_count": number, "status": "success", "error": None})
    assert [r.id for r in log.entries().orderBy("id").collect()] == [4, 5, 6, 7]
    # A reader of an older manifest still finds its parts; a second writer of a number is refused.
    assert log._publish(7, ["other"]) is False and log.entries().count() == 4


def test_patch_with_several_updates_of_a_key(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id int, n int, s string")
    updates = spark.createDataFrame([(1, 7, None), (1, 9, None), (1, None, "z"), (3, 1, "q")], "id int, n int, s string")
    assert rows(changes.patch(table, updates)) == [(1, 9, "z"), (2, 6, "b")]


def test_columns_are_listed_without_reading(spark, tables):
    listed = stats.list_columns(tables.restaurants)
    assert "Scan parquet" not in plan(listed)
    described = stats.describe(tables.restaurants).drop("nulls")
    assert rows(listed) == rows(described)
