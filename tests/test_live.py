"""Live traces in two runs over one checkpoint against a plain loop."""

import math
import random
from collections import Counter

from driftline.streaming import live


def plain(rows, final, ttl=3600.0):
    """Statuses by driver, in order of arrival; final: the last watermark."""
    out, users = [], {}
    for u, seq, kind, item, at, x, asked, outcome in rows:
        s = users.get(u)
        if s and at is not None and at - s["last"] > ttl:
            out.append((u, None, s["last"] + ttl, "EVICTED", False, s["gen"]))
            s = users.pop(u) and None
        gen = s["gen"] if s else None
        if kind == "result":
            if s is None or asked != gen:
                out.append((u, seq, at, "REFUSED", False, gen))
            else:
                if outcome in ("MATCHED", "PARTIAL_MATCH"):
                    s.update(match=at, moved=0.0)
                out.append((u, seq, at, outcome, False, gen))
            continue
        if at is None or x is None or not math.isfinite(x):
            out.append((u, seq, at, "INVALID_GPS", False, gen))
            continue
        if s is None:
            s = users[u] = {"last": at, "n": 0, "still": 0, "moved": 0.0, "match": None, "gen": seq, "ids": {}, "x": x}
        old = s["ids"].get(item)
        if old and old[0] // 3600 >= s["last"] // 3600 - 1:
            out.append((u, seq, at, "DUPLICATE" if old == (at, x) else "CONFLICT", False, s["gen"]))
            continue
        if at < s["last"]:
            out.append((u, seq, at, "STALE_OBSERVATION", False, s["gen"]))
            continue
        s["ids"][item] = (at, x)
        if at - s["last"] > 60:
            s.update(last=at, x=x, n=1, still=0, match=None, gen=seq)
            out.append((u, seq, at, "GAP_RESET", False, seq))
            continue
        if s["n"]:
            step = abs(x - s["x"])
            s["moved"] += step
            s["still"] = s["still"] + 1 if step < 5 else 0
        s.update(last=at, x=x, n=s["n"] + 1)
        if s["n"] < 3:
            out.append((u, seq, at, "WARMING_UP", False, s["gen"]))
            continue
        rests = s["still"] >= 3 and s["match"] is not None
        out.append((u, seq, at, "GPS_ACCEPTED", not rests and (s["moved"] >= 50 or s["match"] is not None and at - s["match"] >= 10), s["gen"]))
    out += [(u, None, s["last"] + ttl, "EVICTED", False, s["gen"]) for u, s in users.items() if s["last"] + ttl <= final]
    return out


def drawn(rng, users=12, n=900):
    rows, clock, gens, seen = [], dict.fromkeys(range(users), 0.0), {}, {}
    t = 0.0
    for seq in range(n):
        t += rng.choice([1, 2, 4, 4, 7])
        u = rng.choice([0, 0, 0, *range(users)])
        if rng.random() < 0.3 and u in gens:
            rows.append((u, seq, "result", None, t, None, rng.choice([gens[u][-1]] * 4 + gens[u][-2:]), rng.choice(live.OUTCOMES)))
            continue
        item, x, at = seq, rng.choice([0.0, 1.0, 30.0, 80.0, 200.0]), t
        what = rng.random()
        if what < 0.05:
            x = rng.choice([None, math.nan, math.inf])
        elif what < 0.12:
            at = t - rng.choice([30, 90])
        elif what < 0.2 and u in seen:
            item, at, x = seen[u]
            x = x if what < 0.15 else x + 1
        elif what < 0.21:
            at = None
        if x is not None and math.isfinite(x) and at is not None and what >= 0.2:
            if u not in gens or at - clock[u] > 60:
                gens.setdefault(u, []).append(seq)
            clock[u], seen[u] = at, (item, at, x)
        rows.append((u, seq, "gps", item, at, x, None, None))
        if rng.random() < 0.01:
            t += 4000
    return rows


def test_two_runs_equal_a_plain_loop(spark, tmp_path):
    rows = drawn(random.Random(4))
    cut = len(rows) // 2
    schema = live.INPUT
    got = []
    for part, some in enumerate((rows[:cut], rows[cut:])):
        spark.createDataFrame(some, schema).coalesce(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="2 minutes")
        with live.state_store(spark):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    got = [(r.user_id, r.seq, r.at_s, r.status, r.asks, r.generation) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    final = max(r[4] for r in rows if r[4] is not None) - 120
    want = plain(rows, final)
    kinds = Counter(w[3] for w in want)
    assert {*live.OUTCOMES, "WARMING_UP", "GPS_ACCEPTED", "INVALID_GPS", "STALE_OBSERVATION", "GAP_RESET", "DUPLICATE", "CONFLICT", "REFUSED", "EVICTED"} == set(kinds), kinds
    assert min(kinds.values()) >= 3 and any(w[4] for w in want), kinds
    assert sorted(map(str, got)) == sorted(map(str, want))
