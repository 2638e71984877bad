import random

import numpy as np
import pytest

from wareloom.streaming import keyed, outcomes


def run(spark, folder, schema, batches, start):
    """Feed ``batches`` one by one into a stream that stops and starts again from its checkpoint after each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/in/part={k}")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in/*")).awaitTermination()


def walk(rows, threshold, delay, state):
    """What ``ask_hosts`` says of a host's rows, row by row."""
    out = []
    for i, ts, kind, rung in rows:
        verdict, at = kind, None
        if kind == "clear":
            state["streak"], state["rung"] = 0, None
        elif state["streak"] >= threshold:
            verdict = "fast_fail"
        else:
            verdict, at = "go", max(ts, state["free"])
            state["free"] = at + delay
            state["streak"] = state["streak"] + 1 if kind == "refused" else 0
            if kind == "answered":
                state["rung"] = None if rung == "A1" else rung
        state["longest"] = max(state["longest"], state["streak"])
        out.append((i, verdict, at, state["streak"], state["longest"], state["rung"]))
    return out


def test_hosts_row_by_row(spark, tmp_path):
    r = random.Random(8)
    batches, number = [], 0
    for _ in range(3):
        rows = []
        for _ in range(150):
            number += 1
            rows.append((r.choice("abc"), number, r.randrange(3000) * 1000, r.choices(["refused", "answered", "clear"], [6, 3, 1])[0], r.choice(["A1", "B", None])))
        rows += [(None, 0, 1, "refused", "B"), ("a", None, 1, "refused", "B"), ("a", 1, None, "refused", "B"), ("a", 0, 1, None, "B"), ("a", 0, 1, "other", "B")]
        r.shuffle(rows)
        batches.append(rows)
    schema = "host string, id long, ts long, kind string, rung string"
    run(spark, tmp_path, schema, batches, lambda s: keyed.write_updates(keyed.ask_hosts(s, threshold=3, delay=0.002), f"{tmp_path}/out", f"{tmp_path}/c"))
    got = {}
    for x in spark.read.schema(keyed.HOSTS).parquet(f"{tmp_path}/out/batch=*").collect():
        assert (x.host, x.id) not in got
        got[x.host, x.id] = (x.verdict, x.starts_at, x.streak, x.longest, x.rung)
    for host in "abc":
        state = {"streak": 0, "longest": 0, "rung": None, "free": 0}
        for rows in batches:
            own = sorted((ts, i, kind, rung) for h, i, ts, kind, rung in rows if h == host and i is not None and ts is not None and kind in ("refused", "answered", "clear"))
            for i, *want in walk([(i, ts, kind, rung) for ts, i, kind, rung in own], 3, 2000, state):
                assert got.pop((host, i)) == tuple(want)
    assert not got


def test_what_failed_fast_comes_again(spark, tmp_path):
    schema = "host string, id long, ts long, kind string, rung string"
    refused = [("a", k, k, "refused", None) for k in range(5)]
    batches = [refused, [("b", 9, 9, "answered", "B")], [("a", 10, 10, "refused", None), ("a", 11, 11, "answered", "B")]]
    run(spark, tmp_path, schema, batches, lambda s: keyed.write_updates(keyed.ask_hosts(s, threshold=3, delay=0.001, cool_ms=1), f"{tmp_path}/out", f"{tmp_path}/c"))
    got = sorted((x.host, x.id, x.verdict, x.streak) for x in spark.read.schema(keyed.HOSTS).parquet(f"{tmp_path}/out/batch=*").collect())
    assert got == [("a", 0, "go", 1), ("a", 1, "go", 2), ("a", 2, "go", 3), ("a", 3, "fast_fail", 3), ("a", 3, "retry", 0), ("a", 4, "fast_fail", 3), ("a", 4, "retry", 0),
                   ("a", 10, "go", 1), ("a", 11, "go", 0), ("b", 9, "go", 0)]


def test_streaks_and_starts():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 20)
        kinds = r.choices(["refused", "answered", "clear"], [5, 2, 1], k=n)
        ts, begin, free = sorted(r.randrange(50) for _ in range(n)), r.randrange(4), r.randrange(20)
        state = {"streak": begin, "longest": 0, "rung": None, "free": free}
        want = walk([(k, t, kind, None) for k, (t, kind) in enumerate(zip(ts, kinds, strict=True))], 3, 7, state)
        asked, after = keyed.streaks(np.array([k == "refused" for k in kinds]), np.array([k == "clear" for k in kinds]), begin, 3)
        assert asked.tolist() == [w[1] == "go" for w in want] and after.tolist() == [w[3] for w in want]
        assert keyed.starts(np.array(ts)[asked], free, 7).tolist() == [w[2] for w in want if w[1] == "go"]


def test_failed_keys_pass_again_and_done_ones_do_not(spark, tmp_path):
    r = random.Random(4)
    batches = [[(r.choice("abcdef"), 1000 * b + k, r.randrange(400), r.choices(["request", "failed", "done"], [8, 4, 1])[0]) for k in range(60)] for b in range(3)]
    batches[1] += [(None, 1, 1, "request"), ("a", None, 1, "request"), ("a", 1, 1, "asked")]
    run(spark, tmp_path, "key string, id long, ts long, kind string", batches, lambda s: keyed.write_updates(keyed.let_through(s), f"{tmp_path}/out", f"{tmp_path}/c"))
    got = sorted((x.key, x.id, x.attempt) for x in spark.read.schema(keyed.TRIES).parquet(f"{tmp_path}/out/batch=*").collect())
    want, state = [], {k: [False, False, 0] for k in "abcdef"}
    for rows in batches:
        for _, i, key, kind in sorted((ts, i, key, kind) for key, i, ts, kind in rows if key and i is not None and kind != "asked"):
            s = state[key]
            if kind == "request" and not s[0] and not s[1]:
                s[1], s[2] = True, s[2] + 1
                want.append((key, i, s[2]))
            elif kind == "failed":
                s[1] = False
            elif kind == "done":
                s[0] = True
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_of_shuffled_batches(spark, tmp_path, seed):
    r = random.Random(seed)
    order = sorted(range(300), key=lambda k: k + r.randrange(60))
    batches = [[(k, f"row {k}") for k in order[a : a + 60]] for a in range(0, 300, 60)]
    batches[2] += [(order[0], "again"), (order[70], "again"), (None, "no index"), (-3, "below")]
    batches.append([(r.choice(order), "again")])
    started = [spark.createDataFrame(b, "i long, t string").coalesce(3) for b in batches]
    seen, out = set(), 0
    for k, frame in enumerate(started):
        frame.write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("i long, t string").parquet(f"{tmp_path}/in/*")
        outcomes.write_prefix(stream, "i", f"{tmp_path}/rows", f"{tmp_path}/c").awaitTermination()
        seen |= {i for i, _ in batches[k] if i is not None}
        while out in seen:
            out += 1
        got = spark.read.schema("i long, t string").parquet(f"{tmp_path}/rows/out/batch=*").collect()
        assert sorted(x.i for x in got) == list(range(out)) and all(x.t == f"row {x.i}" for x in got if k < 2)
    assert out == 300
    # what is all out is gone, but for what the last batch may need again
    assert {p.name for p in (tmp_path / "rows" / "state").iterdir()} == {"batch=4", "batch=5"}


def test_batches_behind_a_gap_are_not_read_again(spark, tmp_path):
    """While the first row is missing, the rows of earlier batches may even be gone: later batches don't look at them."""
    for k, rows in enumerate([range(1, 50), range(50, 90), [*range(100, 120)]]):
        spark.createDataFrame([(i,) for i in rows], "i long").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        outcomes.write_prefix(spark.readStream.schema("i long").parquet(f"{tmp_path}/in/*"), "i", f"{tmp_path}/rows", f"{tmp_path}/c").awaitTermination()
        for p in (tmp_path / "rows" / "in" / f"batch={k}").glob("*.parquet"):
            p.rename(p.with_suffix(".away"))
    assert spark.read.schema("i long").parquet(f"{tmp_path}/rows/out/batch=*").count() == 0
    spans = spark.read.parquet(f"{tmp_path}/rows/state/batch=2").where("batch >= 0").collect()
    assert sum(s.stop - s.start for s in spans) == 49 + 40 + 20


def test_keys_that_share_a_value_of_state(spark, tmp_path):
    """Many keys in two buckets, and the calls to the store go by buckets."""
    r = random.Random(5)
    names = [f"k{n}" for n in range(40)]
    batches = [[(r.choice(names), 1000 * b + k, r.randrange(900), r.choices(["request", "failed", "done", "refused", "answered", "clear"], [8, 4, 1, 8, 3, 1])[0], r.choice(["A1", "B"])) for k in range(500)] for b in range(3)]
    schema = "key string, id long, ts long, kind string, rung string"

    def start(s):
        keyed.write_updates(keyed.let_through(s.drop("rung"), buckets=2), f"{tmp_path}/tries", f"{tmp_path}/c").awaitTermination()
        return keyed.write_updates(keyed.ask_hosts(s.withColumnRenamed("key", "host"), threshold=3, delay=0.0001, buckets=2), f"{tmp_path}/hosts", f"{tmp_path}/d")

    run(spark, tmp_path, schema, batches, start)
    tries = {(x.key, x.id, x.attempt) for x in spark.read.schema(keyed.TRIES).parquet(f"{tmp_path}/tries/batch=*").collect()}
    hosts = {(x.host, x.id): (x.verdict, x.starts_at, x.streak, x.longest, x.rung) for x in spark.read.schema(keyed.HOSTS).parquet(f"{tmp_path}/hosts/batch=*").collect()}
    want = set()
    for key in names:
        done, running, n, state = False, False, 0, {"streak": 0, "longest": 0, "rung": None, "free": 0}
        for rows in batches:
            own = sorted((ts, i, kind, rung) for k, i, ts, kind, rung in rows if k == key)
            for _, i, kind, _ in own:
                if kind == "request" and not done and not running:
                    running, n = True, n + 1
                    want.add((key, i, n))
                running, done = running and kind != "failed", done or kind == "done"
            for i, *says in walk([(i, ts, kind, rung) for ts, i, kind, rung in own if kind in ("refused", "answered", "clear")], 3, 100, state):
                assert hosts.pop((key, i)) == tuple(says)
    assert tries == want and not hosts
