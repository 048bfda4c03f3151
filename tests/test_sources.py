"""Readers, writers, the store, settings and the stream."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from galleria.functions.expr import register
from galleria.sources import config, images, tables
from galleria.streaming.incremental import DuplicateIndex, pending, upsert_stream


def png(w, h):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * (h * (w + 1)))) + part(b"IEND", b"")


def test_scan(spark, tmp_path):
    for name, raw in {"s10/a.png": png(4, 20), "s2/train/b.png": png(30, 40), "s2/c.png": b"", "s2/d.png": png(9, 9)[:-9], "s2/.hidden.png": png(1, 1), "s2/e.txt": b"x", "s2/f.jpg": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    im, su, pr = images.scan_dataset(spark, str(tmp_path))
    got = {r["image_id"]: r for r in im.collect()}
    assert set(got) == {"s10/a.png", "s2/train/b.png", "s2/c.png", "s2/d.png", "s2/f.jpg"}
    assert got["s10/a.png"]["min_side"] == 4 and got["s10/a.png"]["tiny"] and got["s10/a.png"]["aspect_hw"] == 5
    assert got["s2/train/b.png"]["orig_split"] == "train" and got["s2/c.png"]["status"] == "empty_file" and got["s2/d.png"]["status"] == "truncated"
    assert got["s2/f.jpg"]["status"].startswith("corrupt") and got["s2/c.png"]["md5"] == ""
    assert [r["subject"] for r in su.orderBy("order").collect()] == ["s2", "s10"]
    assert ("s2/e.txt", "not an image") in {tuple(r) for r in pr.collect()} and ("s2", "mixed layout") in {tuple(r) for r in pr.collect()}


def test_image_headers():
    assert images.image_size(b"GIF89a" + struct.pack("<HH", 3, 5) + b";") == (3, 5, False)
    exif = b"Exif\0\0" + b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 7, 5, 1) + b"\0"
    jpg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + sof + b"\xff\xd9"
    assert images.image_size(jpg) == (7, 5, False)  # turned: width and height change places


def test_webp_and_tiff_headers():
    from galleria.sources.images import image_size

    riff = lambda body: b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    lossy = riff(b"VP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200))
    lossless = riff(b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 99 | 49 << 14) + b"\0")
    exif = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    large = riff(b"VP8X" + struct.pack("<I", 10) + b"\0" * 4 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little") + b"EXIF" + struct.pack("<I", len(exif)) + exif)
    assert image_size(lossy) == (320, 200, False) and image_size(lossless) == (100, 50, False)
    assert image_size(large) == (480, 640, False) and image_size(lossy[:-1] + b"") is None and image_size(large[:-2])[2]
    for order, head in (("<", b"II*\0"), (">", b"MM\0*")):
        tags = [(256, 3, 1, struct.pack(order + "HH", 70, 0)), (257, 4, 1, struct.pack(order + "I", 90))]
        body = struct.pack(order + "IH", 8, len(tags)) + b"".join(struct.pack(order + "HHI", *t[:3]) + t[3] for t in tags)
        assert image_size(head + body) == (70, 90, False)
    assert image_size(b"II*\0" + b"\xff" * 20) is None and image_size(b"RIFF\0\0\0\0WEBPxxxx") is None


def test_config_files(tmp_path):
    import json

    from galleria.sources.config import dump_config, load_config

    inner = tmp_path / "data" / "released"
    for s in ("a", "b"):
        (inner / s).mkdir(parents=True)
    (tmp_path / "c.yaml").write_text("seed: 007\nlr: 1e-3\ncode: '0012'\npaths: {root: data, out: results, none: null}\ngrid: [1e-4, 3.0e-4]\nfamilies:\n  - {key: a, basic: true}\n", encoding="utf-8")
    c = load_config(str(tmp_path / "c.yaml"), ["seed=9", "families=[x]"], ("root",))
    assert c.seed == 9 and c.lr == 0.001 and c.code == "0012" and c.grid == [1e-4, 3e-4] and c.families == ["x"]
    assert c.paths.root == str(inner) and c.paths.out == str(tmp_path / "results") and c.paths.none is None
    dump_config(c, str(tmp_path / "out" / "c.json"))
    assert json.loads((tmp_path / "out" / "c.json").read_text()) == c and load_config(str(tmp_path / "out" / "c.json")).grid == c.grid


def test_summaries_and_tables(spark, tmp_path):
    from galleria.operators import reports
    from galleria.sources import tables

    models = tables.registry(spark, [{"key": "a", "name": "A", "family": "f", "basic": True}, {"key": "b", "family": "g", "square_only": True}])
    e3 = spark.createDataFrame([("a", "proto", 1, d, 50.0 + d, 40.0) for d in range(3)] + [("b", "lp", 5, 0, 70.0, 60.0)], "model string, classifier string, shot int, draw int, top1 double, top1_subject_mean double")
    out = str(tmp_path / "results")
    assert tables.write_summaries({"E3": e3, "E1": e3.limit(0)}, models, out) == ["E3_identity_fewshot"]
    got = {r["model"]: r for r in spark.read.option("header", True).csv(f"{out}/E3_identity_fewshot.csv").collect()}
    assert got["a"]["n_runs"] == "3" and float(got["a"]["top1_mean"]) == 51 and float(got["a"]["top1_std"]) == 1 and float(got["a"]["top1_ci95"]) == 2.4841
    assert "E3_identity_fewshot" in (tmp_path / "results" / "README.md").read_text()
    assert tables.write_summaries({}, models, out) == [] and not (tmp_path / "results" / "E3_identity_fewshot.csv").exists()
    s = {"seeds": 3, "folds": 5, "identity_shots": (1, 5), "gender_shots": (1,), "linear_shots": (1,), "proto_draws": 3, "linear_draws": 2, "gallery_runs": 2, "restarts": 2, "retrieval_shots": (1,), "retrieval_runs": 2, "datasets": ("x",), "grid": [0.1], "bins": ["[0,8)"]}
    e8 = spark.createDataFrame([("b", "frozen", "x", 10.0, 20.0, 30.0)], "model string, variant string, dataset string, rank1 double, rank5 double, aucmc double")
    res = spark.createDataFrame([("a", "[0,8)", 12, 33.333)], "model string, bin string, n_images int, top1 double")
    e0 = spark.createDataFrame([("b", "stretch", 9.0)], "model string, mode string, test_top1 double")
    all_ = {k: {r["name"]: r.asDict() for r in v.collect()} for k, v in reports.build_tables(models, {"E0": e0, "E3": e3, "E8": e8, "resolution": res}, s).items()}
    assert all_["E3"]["A"]["Proto 1-shot"] == "51.00 ± 2.48" and all_["E3"]["A"]["LP 5-shot"] == "–" and all_["E3"]["b"]["LP 5-shot"] == "70.00 (n=1/2)"
    assert all_["E8"].keys() == {"b"} and all_["E8"]["b"]["x rank5"] == "20.00" and all_["E8"]["b"]["variant"] == "frozen"
    assert all_["resolution"]["A"]["[0,8)"] == "33.33" and all_["resolution"]["images"]["[0,8)"] == "12"
    assert all_["E0"].keys() == {"b"} and all_["E0"]["b"]["stretch"] == "9.00" and all_["E0"]["b"]["nonsquare"] == "(not applicable)"
    assert all_["E1"]["A"]["top1"] == "–" and all_["E56"]["b"]["identity ari"] == "–"


def test_select_rows_and_last_match(spark):
    from galleria.operators import summary

    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "y")], "model string, lr double, fp string").coalesce(1)
    assert summary.select_rows(df, model="a").count() == 2 and summary.select_rows(df, unknown="a").isEmpty()
    planned = spark.createDataFrame([("a", 1.0, "y"), ("a", 2.0, "y")], "model string, lr double, fp string")
    assert [r["skip"] for r in summary.should_skip(df, planned, ["model", "lr"], ["fp"]).orderBy("lr").collect()] == [True, False]


def test_csv_nulls_and_leading_zeros(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,name\n001,NA\n002,\n003,"a ""b"", c"\n')
    got = [tuple(r) for r in tables.read_csv(spark, str(p), "id string, name string").orderBy("id").collect()]
    assert got == [("001", "NA"), ("002", None), ("003", 'a "b", c')]
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"), "id string")
    tables.write_csv(spark.createDataFrame(got, "id string, name string"), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), "id string, name string").count() == 3


def test_features(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, -2.5])], "image_id string, embedding array<double>")
    tables.save_features(df, str(tmp_path / "f"), {"model": "m"}, half=True)
    ids = df.select("image_id")
    got = {r["image_id"]: r["embedding"] for r in tables.load_features(spark, str(tmp_path / "f"), ids, {"model": "m"}).collect()}
    assert got["b"] == [0.0, -2.5] and got["a"][1] == pytest.approx(0.0999756)
    with pytest.raises(ValueError):
        tables.load_features(spark, str(tmp_path / "f"), ids, {"model": "x"})
    with pytest.raises(KeyError):
        tables.load_features(spark, str(tmp_path / "f"), spark.createDataFrame([("z",)], "image_id string"))


def test_store(spark, tmp_path):
    s = tables.ResultStore(spark, str(tmp_path / "store"), ["model", "seed"])
    row = lambda m, k, v: spark.createDataFrame([(m, k, v)], "model string, seed int, value double")
    assert s.load() is None and s.get(model="a") is None
    for m, k, v in (("a", 0, 1.0), ("a", 1, 2.0), ("a", 0, 3.0)):
        s.upsert(row(m, k, v))
    assert s.load().count() == 2 and s.get(model="a", seed="0")["value"] == 3.0
    with pytest.raises(KeyError):
        s.upsert(row("a", 0, 1.0).drop("seed"))
    plan = spark.createDataFrame([("a", 0, 3.0 * (1 + 1e-14)), ("a", 1, 2.1), ("b", 0, 1.0)], "model string, seed int, value double")
    assert [r["skip"] for r in s.should_skip(plan, ["value"]).orderBy("model", "seed").collect()] == [True, False, False]
    assert not any(r["skip"] for r in s.should_skip(plan, ["value"], overwrite=True).collect())
    assert s.remove(seed=1) == 1 and s.load().count() == 1
    s.replace_rows("a", row("a", 7, 1.0).withColumn("more", F.lit("x")))
    assert [r["seed"] for r in s.load().collect()] == [7]


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    path = tmp_path / "store"
    s = tables.ResultStore(spark, str(path), ["model", "seed"], buckets=8)
    rows = lambda data: spark.createDataFrame(data, "model string, seed int, value double")
    files = lambda: {p.parent.name: p.name for p in path.glob("*/*.parquet")}
    s.upsert(rows([(f"m{k}", k % 3, float(k)) for k in range(60)] + [(None, 1, 0.5)]))
    before = files()
    assert len(before) == 8
    s.upsert(rows([("m5", 2, -1.0)]))
    after = files()
    assert sum(before[b] != after[b] for b in before) == 1 and s.get(model="m5", seed=2)["value"] == -1.0
    s.upsert(rows([(None, 1, 0.75)]).withColumn("note", F.lit("x")))  # a new column, and a null key
    last = files()
    assert sum(after[b] != last[b] for b in after) == 1
    got = {(r["model"], r["seed"]): (r["value"], r["note"]) for r in s.load().collect()}
    assert len(got) == 61 and got[None, 1] == (0.75, "x") and got["m7", 1] == (7.0, None)
    assert s.has(model="m7", seed="1") and not s.has(model="m7", seed=2) and not s.has(unknown=1) and s.has(note="x")
    only = next(b for b in last if sum(1 for r in spark.read.parquet(str(path / b)).collect()) > 0)
    held = [(r["model"], r["seed"]) for r in spark.read.parquet(str(path / only)).collect()]
    for m, k in held:
        if m is not None:
            assert s.remove(model=m, seed=k) == 1
    assert s.load().count() == 61 - sum(m is not None for m, _ in held) and (only not in files() or (None, 1) in held)
    s.upsert(spark.createDataFrame([("m1", "text", "t")], "model string, seed string, value string"))  # types change: all is written
    assert s.get(model="m1", seed="text")["value"] == "t" and s.get(model="m7", seed=1)["value"] == "7.0" or (("m7", 1) in held)


def test_duplicate_index_equals_a_search_from_scratch(spark, tmp_path):
    """Random batches with repeated, new and changed images: groups as if all had been searched at once, and few are hashed."""
    r = random.Random(13)
    base = [r.getrandbits(64) for _ in range(6)]
    near = lambda: r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
    index, now, hashed = DuplicateIndex(spark, str(tmp_path / "index"), 4, 4), {}, 0
    for step in range(4):
        fresh = {k: (f"d{step}.{k}", f"s{k % 2}", near()) for k in r.sample(range(60), 25) if k not in now or r.random() < 0.3}
        now |= fresh
        batch = {k: now[k] for k in r.sample(sorted(now), len(now) // 2)} | fresh
        rows = [(k, d, s, h - (1 << 64) if h >> 63 else h) for k, (d, s, h) in batch.items()]
        table = spark.createDataFrame(rows, "id long, digest string, subject string, h long")
        hashed += index.add(table.drop("h"), lambda rows, table=table: rows.join(table.select("id", "h"), "id"))
        group = {k: k for k in now}
        for a in sorted(now):
            for b in sorted(now):
                if a < b and now[a][1] == now[b][1] and (now[a][2] ^ now[b][2]).bit_count() <= 4 and group[a] != group[b]:
                    x, y = sorted((group[a], group[b]))
                    group = {k: x if g == y else g for k, g in group.items()}
        assert {x["id"]: x["grp"] for x in index.groups().collect()} == group
    assert hashed < 130


def test_registry_and_reports(spark, tmp_path):
    m = tables.registry(spark, [{"key": "b", "family": "f2", "basic": True}, {"key": "a", "family": "f1"}])
    assert [r["key"] for r in tables.select_models(m, "all").collect()] == ["b", "a"]
    assert [r["key"] for r in tables.select_models(m, "basic").collect()] == ["b"]
    assert [r["family"] for r in tables.families(m).collect()] == ["f2", "f1"]
    with pytest.raises(KeyError):
        tables.select_models(m, "a,zz")
    t = spark.createDataFrame([("a_b", "1.00 ± 0.50")], "model string, top1 string")
    assert tables.to_markdown(t) == "| model | top1 |\n| --- | --- |\n| a_b | 1.00 ± 0.50 |\n"
    assert tables.to_markdown(t.limit(0)) == "No results yet.\n"
    assert r"a\_b & 1.00 $\pm$ 0.50" in tables.to_latex(t, "x")
    tables.write_tables({"E1": t}, str(tmp_path / "r"))
    assert (tmp_path / "r/all_tables.md").exists() and (tmp_path / "r/E1.tex").exists()


def test_settings():
    c = config.Config.wrap({"a": {"b": 1}, "x": [1]})
    config.override(c, "a.b=0300")
    assert c.a.b == 300 and [config.parse_value(t) for t in ("1e-4", "1_000", "0x10", "true", "null", "word", "[1, 2]")] == [1e-4, 1000, 16, True, None, "word", [1, 2]]
    for bad in ("a.c=1", "q=1"):
        with pytest.raises(KeyError):
            config.override(c, bad)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT hamming64(5, 6), natural_key('a10') < natural_key('a9'), dot_product(l2_normalize(array(3D, 4D)), array(1D, 0D))").first()[:2] == (2, False)


def test_pending(spark):
    a = spark.createDataFrame([("x", "f1"), ("y", "f1"), ("z", None)], "id string, fp string")
    assert [r["id"] for r in pending(a, a.filter("id <> 'y'"), ["id", "fp"]).collect()] == ["y"]


def test_stream_upserts_latest_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = "model string, seed int, at int, value double"
    for n, part in enumerate([[("a", 0, 1, 1.0), ("a", 0, 2, 2.0)], [("a", 0, 3, 5.0), ("b", 0, 1, 7.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        store = tables.ResultStore(spark, str(tmp_path / "store"), ["model", "seed"])
        upsert_stream(spark.readStream.schema(schema).parquet(str(src)), store, "at", str(tmp_path / "cp")).awaitTermination()
        got = {r["model"]: r["value"] for r in store.load().collect()}
        assert got == ({"a": 2.0} if n == 0 else {"a": 5.0, "b": 7.0})
