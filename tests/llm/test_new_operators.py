"""Hard negatives, removal of repeated passages and repair of conversations against brute force, and mended cases of others."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.llm import negatives, pii, queries, repair, sharding, substrings, suffixes, toxicity

SF = "/root/testdata/sf0.001"
FAR = np.iinfo(np.int64).max


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# hard negatives


def mined(rows, every, k=5, m=10):
    """rows of (id, vector, label), None where they take no part."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, x, label) in enumerate(kept):
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, v, strict=False)), i, y, n) for n, (i, v, y) in enumerate(kept)]
        near = sorted((s, i) for s, i, y, n in scores if y == label and n != at)[:k]
        for score, p in near:
            far = sorted((s, i) for s, i, y, _ in scores if y != label and 30 * -score <= 100 * -s <= 90 * -score)[:m]
            out += [(a, p, rank + 1, i, -score, -s) for rank, (s, i) in enumerate(far)]
    return by_text(out)


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 6))
    rows = [(k, (base[k % 6] * (0.2 if k % 3 else 1) + rng.normal(size=6) * 0.3).round(2).tolist(), int(k % 4)) for k in range(160)]
    rows += [(7, rows[7][1], 1), (20, rows[20][1], 0), (20, rows[20][1], 0), (None, rows[1][1], 1), (5, None, 2), (10, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (30, [float("nan")] * 6, 2), (40, [float("inf")] * 6, 1)]
    return rows + [(50, [], 1), (60, [0.0] * 6, 2), (70, [1.5], 3), (90, rows[3][1], None), (110, [9e4, -9e4, 1.0, 0.0, 0.0, 0.0], 0)]


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_negatives_against_all_pairs(spark, monkeypatch, block, scale):
    monkeypatch.setattr(negatives, "LEAST_ROWS", block)
    monkeypatch.setattr(negatives, "MOST_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK", 5 if block == 16 else 8192)
    monkeypatch.setattr(negatives, "DEPTH", 2)
    rows = [(i, v if v is None else [None if x is None else x * scale for x in v], y) for i, v, y in vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "score": F.lit("x"), "my col": F.lit(2)})
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert by_text(got.collect()) == mined(rows, 10)


def test_sorted_access_stops_early():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3)).round(3) * 100
    lists = negatives.Lists(x, np.arange(5000))
    [(rows, scores)], depth = lists.search(np.array([3.0, -2.0, 0.0]), [(4, None, None)])
    want = np.lexsort((np.arange(5000), -(x @ [3, -2, 0]).astype(np.int64)))[:4]
    assert rows.tolist() == want.tolist() and depth < 2500


def test_no_anchor_gives_no_rows(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


# repeated passages


def cut(docs, span=50):
    """rows of (id, text); a null id is greater than all."""
    order = lambda k: math.inf if k is None else k
    first = {}
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first[b[i : i + span]] = min(order(k), first.get(b[i : i + span], math.inf))
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < order(k):
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return by_text(out)


def passages():
    rng = random.Random(4)
    parts = ["ab" * 28, "x" * 70, "the quick brown fox jumps over the lazy dog and runs away "]
    docs = [(k, "".join(rng.choice("ab\0é") if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    docs += [(500, docs[3][1]), (3, docs[3][1]), (None, docs[7][1]), (None, "q" * 60), (None, "q" * 60), (7, None), (8, ""), (9, "zz" * 26), (9, "zz" * 26), (2, "y" * 49), (4, "y" * 49), (1, "y" * 50), (2**62, "y" * 51)]
    return docs + [(1000 + k, "w" * (50 + k % 9)) for k in range(30)]


@pytest.mark.parametrize("small", [False, True])
def test_passages_against_all_strings(spark, monkeypatch, small):
    """Small blocks, slices, parts and shards take the ways that large inputs take."""
    if small:
        for name, value in {"PART_ROWS": 20, "SHARD_ROWS": 60, "SENT_ROWS": 25, "BLOCK_BYTES": 9_000, "BUCKET_BYTES": 50_000, "SLICE": 500}.items():
            monkeypatch.setattr(substrings, name, value)
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit(1), "id": F.lit("x"), "my col": F.lit(2)})
    assert by_text(substrings.repeated(df.repartition(4)).collect()) == cut(docs)


def test_passages_of_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_text(queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()) == cut(docs)


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(40):
        rows, width, letters, span = rng.integers(1, 30), int(rng.choice([12, 24, 80])), rng.integers(1, 4), 5
        sizes = rng.integers(1, width + 1, rows)
        texts = np.zeros((rows, width), np.uint8)
        for i in range(rows):
            texts[i, : sizes[i]] = rng.integers(0, letters, sizes[i])
        suffix = lambda p: texts[p // width, p % width : sizes[p // width]].tobytes()  # noqa: B023, E731
        want = sorted((suffix(i * width + c), i) for i in range(rows) for c in range(sizes[i]))
        order, rank = suffixes.suffix_array(texts, sizes)
        assert [(suffix(p), p // width) for p in order] == want
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert suffixes.common_prefixes(texts, sizes, order, rank, 1000).tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]
        least = rng.integers(0, 9, rows)
        strings = {}
        for i in range(rows):
            for c in range(sizes[i] - span + 1):
                key = texts[i, c : c + span].tobytes()
                strings[key] = min(strings.get(key, 99), least[i])
        got = suffixes.least_of(texts, sizes, least, int(rng.choice([3, 7, 100])), span)
        assert got.tolist() == [[strings[texts[i, c : c + span].tobytes()] if c + span <= sizes[i] else FAR for c in range(width - span + 1)] for i in range(rows)]


# repair


def edits(rows, most=3):
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if i < len(rows):
            fault, initial = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", inserted)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 * (fault == repair.CUT)
                if initial:
                    go(i + 1, roles + initial, cost + more, audit + "K", inserted)
                for x in "ua":
                    go(i + 1, roles + x, cost + more + 1, audit + "R", inserted)
        if inserted < most:
            for x in "ua":
                go(i, roles + x, cost + 5, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def test_search_against_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice(["u", "u", "a", "a", "s", "x", ""])) for _ in range(rng.randint(0, 5))]
        assert repair.cheapest(rows) == edits(rows), rows


def test_search_of_a_long_conversation():
    rng = random.Random(2)
    rows = [(rng.choice([0] * 17 + [1, 2, 3]), "ua"[i % 2] if rng.random() > 0.08 else rng.choice("uas")) for i in range(20_000) if rng.random() > 0.05]
    cost, audit = repair.cheapest(rows)
    assert len(audit) - audit.count("I") == len(rows) and cost > 0


def repaired(rows):
    """The contract's rows of (conv_id, turn, role, text), worked out one conversation at a time."""
    blank = lambda v: " " if v is None else str(v)
    talks = {}
    for conv, turn, role, text in rows:
        mine, kind = talks.setdefault(conv, []), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text, role = blank(text), "user" if kind == 4 else blank(role)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in talks.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in mine:
            words = re.sub("[\x20\x09-\x0d]+\\Z", "", text)
            faults.append(repair.BLANK if not words.strip(" \t\n\v\f\r") else repair.DUPLICATE if (role, text) in seen else repair.CUT if words[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        cost, audit = edits(list(zip(faults, initials, strict=True)), 4) if len(mine) < 7 else repair.cheapest(list(zip(faults, initials, strict=True)))
        turns = [t for t, _, _ in mine if t is not None]
        lines, due, at = [], "user", iter(mine)
        for letter in audit:
            _, role, text = next(at) if letter != "I" else (None, due, "")
            if letter != "D":
                role = role if letter == "K" else due
                lines.append(f"{role}:{text}")
                due = "assistant" if role[0] == "u" else "user"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return by_text(out)


def test_repair_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_text(queries.QUERIES["op13_conversation_repair"](spark, SF).collect()) == repaired(rows)


def test_repair_of_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    say = ["Hi.", "No", "Yes!\n", " \t", "", None, "Long " * 3000 + "?", "\u2003", "é."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(say)) for _ in range(250)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"nth": F.lit(1), "my col": F.lit(2)})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_text(queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()) == repaired(rows)


# mended


@pytest.mark.parametrize("size", [97, 200, 5000])
def test_long_mail_names_leave_nothing(spark, size):
    name = "a" * size + "realsecretname"
    df = spark.createDataFrame([(1, f"write to {name}@{'b' * 330}secrethost.example.com now")], "doc_id long, text string")
    out = pii.replace(df, secret="k").first()["text"]
    assert "secret" not in out and len(out) == len(df.first()["text"])


def test_slots_do_not_depend_on_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    got = []
    for n in ("4", "64"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(by_text(sharding.assign(docs).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


def test_one_text_of_an_id_is_an_example(spark, monkeypatch):
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    docs = spark.createDataFrame([(held[0], f"bad words number {k}") for k in range(500)] + [(k, f"kind words {k}") for k in held[1:]], "`doc.id` long, `my text` string")
    labels = spark.createDataFrame([(k, int(k == held[0])) for k in held], "`doc.id` long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, at, rates, n, prior: seen.append(positive) or (np.zeros(n), 0.0))
    toxicity.train(docs, labels, "doc.id", "my text")
    assert seen[0].sum() == 1 and len(seen[0]) <= len(held) + 1


def test_hot_rows_meet_their_class(spark, monkeypatch):
    """A text, an empty text, a vector and an unusable vector that hold a third of all rows each, hot and not."""
    from trendlake.llm import common, pivots, simhash

    docs = spark.createDataFrame([(k if k % 11 else None, ["same text of many rows here", "", None][k % 3] if k % 4 else f"text {k % 9} of its own kind {k}") for k in range(400)], "doc_id long, text string")
    one, zero = [0.5, 0.25, 1.0], [0.0, 0.0, 0.0]
    vectors = spark.createDataFrame([(k, [one, zero, None, [1.0, float(k % 7), 0.1]][k % 4], ["a", "b", None][k % 3]) for k in range(400)], "vec_id long, embedding array<double>, label string")
    read = lambda: (by_text(map(tuple, simhash.near_duplicates(docs).collect())), by_text(map(tuple, pivots.near_duplicates(vectors).collect())), simhash.keep_one(docs).count())
    cold = read()
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    assert read() == cold and len(cold[0]) == len(cold[1]) == 400
    alone = [r for r in cold[1] if r[0] % 4 in (1, 2) or r[0] % 3 == 2]
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in alone)
    assert {r[1] for r in cold[1] if r[0] % 4 == 0 and r[0] % 3 == 0} == {sum(k % 4 == 0 and k % 3 == 0 for k in range(400)) - 1}
