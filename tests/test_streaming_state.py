import json
import random

from pyspark.sql import functions as F

from loomgraph.streaming import stateful as S

SHAPE = "k string, cid string, at timestamp, note string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("k", "cid", "at", "note"), r))) for r in rows))


def versions(rng, n):
    out = []
    for i in range(n):
        t = f"2024-01-01T00:{rng.randrange(60):02d}:00Z"
        out.append((rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None]), t, f"n{i}"))
    return out


def newest(rows):
    """Time and content id of each key's newest version; rows that tie may differ in their note."""
    out = {}
    for k, c, t, _ in rows:
        if t is not None:
            out[k] = max(out.get(k, ("", "")), (t, c or ""))
    return out


def stream(spark, folder):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).json(str(folder))


def state_of(spark, path):
    rows = S.current(spark, path, ["k"]).select("k", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.coalesce("cid", F.lit("")).alias("c")).collect()
    return {r.k: r.c for r in rows}


def test_any_order_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(8)
    rows = versions(rng, 40) + [("a", "x", None, "no time")]
    want = {k: c for k, (_, c) in newest(rows).items()}
    for turn in range(2):
        rng.shuffle(rows)
        src, out, ck = tmp_path / f"in{turn}", str(tmp_path / f"out{turn}"), str(tmp_path / f"ck{turn}")
        for i in range(0, len(rows), 14):
            put(src, f"f{i:03d}.json", rows[i : i + 14])
        put(src, "z.json", rows[:14])  # repeated
        S.follow(stream(spark, src), ["k"], out, ck).awaitTermination()
        assert state_of(spark, out) == want


def test_status_restart_and_replay(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: S.follow(stream(spark, src), ["k"], out, ck, make=lambda x: x.withColumn("made", F.concat(F.lit("from "), "cid"))).awaitTermination()
    log = lambda: sorted((r.k, r.cid, r.status, r.made) for r in spark.read.parquet(out).collect())
    put(src, "1.json", [("a", "x", "2024-01-01T00:01:00Z", ""), ("b", "x", "2024-01-01T00:01:00Z", "")])
    run()
    assert log() == [("a", "x", "generate", "from x"), ("b", "x", "generate", "from x")]
    # after a restart: unchanged, changed, late and new
    put(src, "2.json", [("a", "x", "2024-01-01T00:02:00Z", ""), ("b", "y", "2024-01-01T00:02:00Z", ""), ("c", "x", "2024-01-01T00:02:00Z", "")])
    run()
    put(src, "3.json", [("b", "z", "2024-01-01T00:01:30Z", ""), ("a", "x", "2024-01-01T00:01:00Z", "")])
    run()
    run()
    assert log() == [("a", "x", "generate", "from x"), ("b", "x", "generate", "from x"), ("b", "y", "regenerate", "from y"), ("c", "x", "generate", "from x")]


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: S.follow(stream(spark, src).withWatermark("at", "1 minute"), ["k"], out, ck, keep="10 minutes").awaitTermination()
    put(src, "1.json", [("a", "x", "2024-01-01T00:01:00Z", "")])
    run()
    put(src, "2.json", [("b", "x", "2024-01-01T01:00:00Z", "")])
    run()
    put(src, "3.json", [("a", "x", "2024-01-01T01:01:00Z", ""), ("b", "x", "2024-01-01T01:01:00Z", "")])
    run()
    assert sorted((r.k, r.status) for r in spark.read.parquet(out).collect()) == [("a", "generate"), ("a", "generate"), ("b", "generate")]
