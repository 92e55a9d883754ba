"""Files, settings, codecs, the service and the shell."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid import cli, metrics
from tallygrid.config import Config, InvalidConfiguration, OnlineConfig
from tallygrid.functions import arrays, codecs
from tallygrid.metrics import Timings, analyze, codec_sizes
from tallygrid.operators import clusters, points, predicates
from tallygrid.operators.match import match
from tallygrid.operators.topk import top_k
from tallygrid.plans import policy
from tallygrid.sources import generate, index
from tallygrid.sources.rows import from_rows, read_clusters, read_predicates, read_rows
from tallygrid.streaming.online import answer, load_points, serve, serve_socket
from tallygrid.workspace import clean, mark, materialize, shared_root, workspace


def test_rows_keep_file_order(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("".join(f"{k},{k * 2} ,x {-k},\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = read_rows(spark, str(p)).orderBy("id").collect()
        first = read_rows(spark, str(p), 2500).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["id"], r["values"]) for r in rows] == [(k, [k, 2 * k, 0, -k]) for k in range(5000)] and first == rows[:2500]
    assert [r["id"] for r in read_rows(spark, str(p), 3).orderBy("id").collect()] == [0, 1, 2]
    assert read_rows(spark, str(p), 1, convert=lambda c: F.length(c)).first()["values"] == [1, 1, 1, 1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_rows(spark, str(tmp_path / "none.csv")).collect()


def test_long_form_and_clusters(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 0 5 0.5 1\nbad line\n1 1 6 0 2\n2 0 7 0.1 1\n")
    assert [tuple(r)[:3] for r in read_predicates(spark, str(tmp_path / "q.txt"), 2).orderBy("dim").collect()] == [(1, 0, 5), (1, 1, 6)]
    for c, r in ((0, 0), (0, 1), (1, 0)):
        (tmp_path / f"d_{c}_{r}.csv").write_text(f"{c},{r}\n9,9\n")
    found = sorted(map(lambda r: (r[0], r[1], r[2], r[3]), read_clusters(spark, str(tmp_path / "d_*.csv")).collect()))
    assert found == [(c, r, k, v) for c, r in ((0, 0), (0, 1), (1, 0)) for k, v in ((0, [c, r]), (1, [9, 9]))]


def test_documents_are_valid_whole_or_dropped(spark):
    good = {"topk": 2, "queries": [{"content": [1, 2], "clusters": [0, 1]}]}
    bad = ["no json", "{}", '{"topk": "x", "queries": []}', '{"topk": 1, "queries": [{"content": [1]}]}', '{"topk": 1, "queries": [{"content": [1], "clusters": ["a"]}]}', None]
    docs = spark.createDataFrame([(k, v) for k, v in enumerate([json.dumps(good), *bad])], "doc long, value string")
    found = clusters.parse_queries(docs).collect()
    assert [(r["doc"], r["topk"], r["qid"], r["content"], r["clusters"]) for r in found] == [(0, 2, 0, [1, 2], [0, 1])]


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"k": 3, "num_of_queries": 2}')
    (tmp_path / "b.cfg").write_text("[x]\nk = 3 # three\nnum-of-queries = 2\nquery-range = 1\n")
    assert Config.from_file(str(tmp_path / "a.json")) == Config(3, 2)
    assert Config.from_file(str(tmp_path / "b.cfg")) == Config(3, 2, 1)
    for bad in (Config(), Config(1, 0), Config(1, 1, 0), Config(1, 1, None, 0)):
        with pytest.raises(InvalidConfiguration):
            bad.validate()
    whole = {"data_file": "x", "dim": 2, "count_threshold": 2, "data_type": 0, "search_type": 0, "max_data_size": 0, "num_of_cluster": 1, "data_format": 0, "radius": 0, "selectivity": 0.2}
    (tmp_path / "o.json").write_text(json.dumps(whole))
    assert OnlineConfig.from_file(str(tmp_path / "o.json")).adaptive
    (tmp_path / "o.json").write_text(json.dumps(whole | {"radius": "x"}))
    with pytest.raises(InvalidConfiguration):
        OnlineConfig.from_file(str(tmp_path / "o.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=300))
def test_codecs_lose_nothing(values):
    x = np.array(values, np.uint32)
    for name, c in codecs.CODECS.items():
        assert c.decode(c.encode(x)).tolist() == values, name


def test_codec_formats():
    assert codecs.CODECS["varint"].encode(np.array([1, 300], np.uint32)).tobytes() == bytes([0x81, 300 & 127, 300 >> 7 | 0x80, 0])
    assert codecs.CODECS["bp32"].encode(np.array([3] * 33, np.uint32)).tolist() == [33, 2 << 24 | 2 << 16, 0xFFFFFFFF, 0xFFFFFFFF, 3, 0]
    assert codecs.codec("unknown") is codecs.COPY
    for n in (0, 1, 7, 8, 127, 128, 1024):
        x = np.arange(n, dtype=np.uint32) * 3
        assert (codecs.CODECS["heavy"].decode(codecs.CODECS["heavy"].encode(x)) == x).all()


def test_codec_columns_and_sizes(spark):
    at = generate.sorted_lists(generate.geometric(spark, 3000), gaps=True)
    for name in ("heavy", "delta-varint"):
        same = at.select((codecs.decode(codecs.encode(F.col("values"), name), name) == F.col("values")).alias("same")).distinct().collect()
        assert [r["same"] for r in same] == [True]
    assert at.select((arrays.undelta(arrays.delta(F.col("values"))) == F.col("values")).alias("s")).distinct().collect()[0]["s"]
    pts = points.vector_points(from_rows(spark, [[k % 3] for k in range(400)]))
    bits = {r["codec"]: r["bits_per_int"] for r in codec_sizes(pts, ["no", "heavy"]).collect()}
    assert bits["no"] == 32 > bits["heavy"]
    assert generate.uniform(spark, 100, 5, 9).where("value BETWEEN 5 AND 9").count() == 100


def test_grams_and_packing(spark):
    row = spark.createDataFrame([([1, 2, 3, 4],), ([7],), ([],)], "v array<int>")
    assert [r[0] for r in row.select(arrays.grams(F.col("v"), 3)).collect()] == [[[1, 2, 3], [2, 3, 4]], [[7, 7, 7]], []]
    row_id, place = arrays.unpack_id(arrays.pack_id(F.lit(6), F.lit(5), 3), 3)
    assert tuple(spark.range(1).select(row_id, place).first()) == (6, 5) and arrays.bits_for(5) == 3


def test_index_round_trip(spark, tmp_path):
    pts = points.vector_points(from_rows(spark, [[k, k % 4] for k in range(50)]))
    index.save_index(pts, str(tmp_path / "i"), 3)
    back = index.load_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pts.collect())) and index.load_bounds(spark, str(tmp_path / "i")).count() == 2
    preds = predicates.radius_predicates(from_rows(spark, [[10, 1]]))
    few = back.where(index.reach(preds))
    assert "PushedFilters: [Or" in few._jdf.queryExecution().toString() and few.count() < 20
    top = top_k(match(few, preds, exact=True), 3)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, top_k(match(pts, preds, exact=True), 3).collect()))
    index.save_results(top, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 3
    assert analyze(back).where("bytes = 4 * n").count() == analyze(back).count()


def test_online_service(spark, tmp_path):
    pts = points.vector_points(from_rows(spark, [[k, k % 4] for k in range(20)])).withColumn("cluster", (F.col("id") % 2).cast("int"))
    doc = json.dumps({"topk": 2, "queries": [{"content": [4, 0], "clusters": [0, 0]}, {"content": [4, 1], "clusters": [1]}, {"content": [5, 1], "clusters": []}]})
    docs = spark.createDataFrame([(0, doc), (1, "{")], "doc long, value string")
    assert sorted(tuple(r)[1:] for r in answer(pts, docs).collect()) == [(0, 0, 1, 2), (0, 4, 2, 1), (1, 1, 1, 1), (1, 5, 1, 2)]
    assert answer(pts, docs, selectivity=0.5).where("qid = 0 AND cnt = 2").count() > 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(doc)
    serve(spark, pts, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_shell(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("1,2\n1,3\n5,5\n")
    (tmp_path / "c.cfg").write_text("k = 2\nnum_of_queries = 9\n")
    args = ["-t", str(tmp_path / "t.csv"), "-q", str(tmp_path / "t.csv"), "-c", str(tmp_path / "c.cfg"), "-n", "1"]
    assert cli.main(["search", *args], spark) == 0
    assert capsys.readouterr().out == "0,0,2,1\n0,1,1,2\n"
    assert cli.main(["search", *args, "-r", "1"], spark) == 0
    assert capsys.readouterr().out == "0,0,2,1\n0,1,2,2\n"
    cli.main(["index", "-i", str(tmp_path / "t.csv"), "-o", str(tmp_path / "i")], spark)
    cli.main(["analyze", "-i", str(tmp_path / "i")], spark)
    assert capsys.readouterr().out.splitlines()[0] == "0,1,2,0,1,8"


def test_timings(spark):
    t = Timings()
    with t.step("x"):
        time.sleep(0.01)
    assert t.frame(spark).first()["seconds"] >= 0.01


@pytest.mark.parametrize("name", [*codecs.CODECS])
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400))
@settings(max_examples=25, deadline=None)
def test_words_hold_any_list(name, values):
    one, x = codecs.codec(name), np.array(values, np.uint32)
    assert one.decode(one.encode(x)).tolist() == values


def test_formats_by_hand():
    assert codecs.BP32.encode(np.array([], np.uint32)).tolist() == [0]
    assert codecs.BP32.encode(np.array([1, 3], np.uint32)).tolist() == [2, 2 << 24, 0b1101, 0]
    assert codecs.VARINT.encode(np.array([1, 300], np.uint32)).tobytes() == bytes([129, 44, 130, 0])


def test_the_service_by_its_settings(spark, tmp_path):
    for c, rows in enumerate(([[1, 2], [3, 4]], [[1, 9], [1, 2]])):
        (tmp_path / f"d_{c}_0.csv").write_text("".join(f"{a},{b}\n" for a, b in rows))
    what = {"data_file": str(tmp_path / "d"), "dim": 2, "count_threshold": 2, "data_type": 0, "search_type": 0, "max_data_size": 0, "num_of_cluster": 2, "data_format": 0, "radius": 0, "selectivity": 0.0}
    (tmp_path / "o.json").write_text(json.dumps(what))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text(json.dumps({"topk": 5, "queries": [{"content": [1, 2], "clusters": [0, 1]}, {"content": [1, 2], "clusters": [1]}]}))
    cli.main(["serve", "-c", str(tmp_path / "o.json"), "-s", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state"), "--once"], spark)
    found = sorted((r["qid"], r["rnk"], r["id"], r["cnt"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(0, 1, 0, 2), (0, 2, 3, 2), (0, 3, 2, 1), (1, 1, 3, 2), (1, 2, 2, 1)]
    (tmp_path / "o.json").write_text(json.dumps(what | {"search_type": 1}))
    bags = load_points(spark, OnlineConfig.from_file(str(tmp_path / "o.json")))
    assert sorted((r["id"], r["dim"], r["value"], r["n"], r["cluster"]) for r in bags.collect()) == [(0, 0, 1, 1, 0), (0, 0, 2, 1, 0), (1, 0, 3, 1, 0), (1, 0, 4, 1, 0), (2, 0, 1, 1, 1), (2, 0, 9, 1, 1), (3, 0, 1, 1, 1), (3, 0, 2, 1, 1)]


def test_figures(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("1,2\n3,4\n1,4\n")
    t = str(tmp_path / "t.csv")
    cli.main(["search", "-t", t, "-q", t, "-k", "2", "-n", "2", "-m", str(tmp_path / "m.csv")], spark)
    assert capsys.readouterr().out.splitlines() == ["0,0,2,1", "0,2,1,2", "1,1,2,1", "1,2,1,2"]
    head, line = (tmp_path / "m.csv").read_text().splitlines()
    assert head.split(",") == metrics.SEARCH_COLUMNS and line.split(",")[6:9] == ["6", "4", "4"]
    assert cli.main(["scan"]) == 0 and capsys.readouterr().out.splitlines()[0].split(",") == metrics.SCAN_COLUMNS
    cli.main(["codecs", "-n", "300"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 1 + len(codecs.CODECS)


def test_work_files_need_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("context", (), {"master": "spark://somewhere:7077", "getConf": staticmethod(lambda: {})})  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        shared_root(Elsewhere)


def test_work_files_are_removed_but_for_what_is_kept(spark):
    first = materialize(spark.range(3), "first")
    before = mark(spark)
    path = workspace(spark, "kept")
    materialize(spark.range(5), "second").write.parquet(path)
    other = materialize(spark.range(4), "third")
    clean(spark, before, keep=[path])
    assert first.count() == 3 and spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="exist"):
        other.count()


def test_documents_over_a_socket(spark, tmp_path):
    import socket
    import threading

    at = points.vector_points(from_rows(spark, [[1, 2], [1, 3]])).withColumn("cluster", F.lit(0))
    line = json.dumps({"topk": 2, "queries": [{"content": [1, 2], "clusters": [0]}]}) + "\n"
    with socket.create_server(("127.0.0.1", 0)) as server:
        def talk():
            with server.accept()[0] as one:
                one.sendall(line.encode())
                time.sleep(20)

        threading.Thread(target=talk, daemon=True).start()
        query = serve_socket(spark, at, "127.0.0.1", server.getsockname()[1], str(tmp_path / "out"), str(tmp_path / "state"))
        found, until = [], time.time() + 60
        while not found and time.time() < until:
            time.sleep(1)
            parts = [str(p) for p in tmp_path.glob("out/batch=*") if (p / "_SUCCESS").exists()]
            found = [tuple(r)[1:] for p in parts for r in spark.read.parquet(p).orderBy("rnk").collect()]
        query.stop()
    assert found == [(0, 0, 2, 1), (0, 1, 1, 2)]


def test_policies(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2\n3,4\n1,5\n")
    t = str(tmp_path / "t.csv")
    rows = lambda c: sorted(tuple(r) for r in policy.search(spark, policy.make_policy(c), t, t).select("qid", "id", "cnt").collect())
    assert rows(Config(2, 1)) == [(0, 0, 2), (0, 2, 1)] and rows(Config(3, 1, 2)) == [(0, 0, 2), (0, 1, 2), (0, 2, 1)]
    one = policy.Bags(Config(1, 1, pad=True))
    at = one.points(from_rows(spark, [[7, 7, 8], [9]]))
    assert [tuple(r)[1:] for r in one.match(at, one.predicates(from_rows(spark, [[7, 8]]))).collect()] == [(0, 3, 1)]
    assert one.match_tables([at, at], one.predicates(from_rows(spark, [[7]]))).count() == 2
    with pytest.raises(InvalidConfiguration):
        policy.make_policy(Config(0, 1))


def test_rows_from_flat_tables(spark):
    """As from flat lists; rows may be empty, and what stands before the first belongs to none."""
    from tallygrid.sources.rows import from_csr, from_flat

    data, starts = [*range(50, 90)], [2, 5, 5, 5, 17, 30, 40]
    values = spark.createDataFrame([*enumerate(data)], "place long, value int").repartition(3)
    found = from_flat(values, spark.createDataFrame([(x,) for x in starts], "start long"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, from_csr(spark, data, starts).collect()))
    assert from_flat(values.limit(0), spark.createDataFrame([(3,)], "start long")).collect() == [(0, [])]
