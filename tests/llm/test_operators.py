"""Small fixtures with nulls, empty and long texts, repeated rows and clashing names, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trendlake.llm import decontaminate, groups, language, packing, pii, pivots, secrets, sharding, simhash, token_counts, toxicity, vocab
from trendlake.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and ring stone river Éa über 7 mañana light".split()


def texts():
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(9000))
    some = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 3, 4, 30, 200)]
    return [None, "", " \n", long, long + " tail", *some, some[3], "a  b\t c\n\nd", "x\x1cy <|endoftext|> z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts())]
    rows += [rows[5], (None, "the ring", None, None, 8)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit(1), "key": F.lit("k"), "component": F.lit(2)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_simhash_against_brute_force(docs, none):
    def brute(t):
        w = re.findall("[^ \t-\r]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))

    rows = simhash.near_duplicates(docs).collect()
    want = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    assert sorted((r.doc_id is None, r.doc_id, int(r.fingerprint, 16)) for r in rows) == sorted((i is None, i, f) for i, f in want)
    known = [(i, f) for i, f in want if i is not None]
    group = {i: i for i, _ in known}
    for _ in known:
        for i, f in known:
            group[i] = min(group[j] for j, g in known if (f ^ g).bit_count() <= 4)
    assert all(r.component_id == group[r.doc_id] for r in rows if r.doc_id is not None)
    kept = simhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == len(set(group.values())) + (not any((brute("the ring") ^ f).bit_count() <= 4 for _, f in known))
    assert simhash.near_duplicates(none).count() == 0


def test_trie_pairs_are_complete():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    a, b = simhash.trie_pairs(keys, np.array([[0, len(keys), 0, len(keys)]]))
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 4
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == {(x, y) for x, y in np.argwhere(near).tolist() if x < y}


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[150:220] = x[0] + 0.02 * rng.normal(size=(70, 16)).astype(np.float32)
    x[220:230] = x[1]
    rows = [(int(i), [float(v) for v in x[i]], int(i % 2) if i < 150 else 0) for i in range(300)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, rows[0][1], None), (404, [None] * 16, 0), (405, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    lab = np.array([r[2] for r in rows[:300]])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(300, dtype=bool)
    found = sum(got[i].n_links for i in range(300))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(300))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 406))
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_pivots_in_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(pivots, "LEAST_PIVOTS", 600)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2400, 64)).astype(np.float32)
    x[:800] = x[0] + 0.229 * rng.normal(size=(800, 64)).astype(np.float32)
    for part in (x, x[:800]):  # the second has one direction alone
        u = part.astype(float) / np.linalg.norm(part.astype(float), axis=1)[:, None]
        near = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(part)], "vec_id long, embedding array<float>, label int")
        found = sum(r.n_links for r in pivots.near_duplicates(df).collect())
        assert near.sum() > 100_000 and 0.999 * near.sum() <= found <= near.sum()


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 500).astype(np.int32)
    s[-1] = 0
    index = FMIndex(s, 3)
    for n in (1, 2, 5):
        patterns = np.unique(rng.integers(1, 4, (30, n)), axis=0)
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_against_brute_force(spark, docs, none, monkeypatch):
    long = texts()[3].split()
    bench = spark.createDataFrame([(1, " ".join(long[50:75])), (2, "RING stone,river"), (10, None), (3, ""), (4, "never seen words here")], "item_id long, text string")
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(str(r[0]), words(r[1])) for r in bench.collect()]

    def brute(t):
        w, hit, names = words(t), set(), set()
        for name, b in items:
            k = min(10, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == b[s : s + k]:
                        hit |= set(range(i, i + k))
                        names.add(name)
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)

    want = sorted((r.doc_id is None, r.doc_id, *brute(r.text)) for r in docs.collect())
    one_pass = sorted((r.doc_id is None, *r) for r in decontaminate.report(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 60)
    several = sorted((r.doc_id is None, *r) for r in decontaminate.report(docs, bench).collect())
    assert want == one_pass == several
    cleaned = decontaminate.remove(docs, bench)
    assert cleaned.dtypes == docs.dtypes and not any(brute(r.text)[4] for r in decontaminate.remove(cleaned, bench).collect())
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = vocab.default_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for _ in range(2):  # the second call finds every text in the cache
        rows = token_counts.count_tokens(docs, path, cache).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.count_tokens(none, path).count() == 0


def test_word_coder_gives_the_ids_of_the_library():
    coder = vocab.WordCoder(vocab.default_path("word_bpe_49k.json"))
    assert coder.words is not None
    draw = random.Random(3)
    alphabet = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA0, 0x180)), *"\t\n\r''''sStTrReEdD", "'S ", "it's", "WE'LL", "Σ", "İ", "é", "字"]
    alphabet += ["’s", "\x85", "\x1c", "<|endoftext|>", "<|", "\U0001f600", "²"]
    latin = [c for c in alphabet if vocab._LATIN.fullmatch(c)]
    for k in range(4000):
        text = "".join(draw.choices(latin if k % 2 else alphabet, k=draw.randrange(40)))
        want = vocab.packed(coder.tokenizer.encode(text, add_special_tokens=False).ids)
        assert [coder.encode(text), coder.encode(text)] == [want, want], text


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = vocab.default_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).toPandas()
    for r in docs.where("doc_id is not null and doc_id <> 5").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = rows[rows.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packing.pack(none, path).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 400) for _ in range(500)]
    parts = packing.differencing(sizes, 40)
    assert sorted(k for _, m in parts for k in m) == list(range(500))
    assert max(t for t, _ in parts) - min(t for t, _ in parts) < 20
    assert all(sum(sizes[k] for k in m) <= 2048 for m in packing.spread(sizes))


def test_secrets(spark, none):
    hexes = "0123456789abcdef" * 2
    cases = [
        ('Token = "abcdefgh1"', "assign:0:18,lexed:9:18"),
        ("password: short", ""),
        (f"é AKIA{'A' * 12} {hexes}", f"access:2:18,hex:19:{19 + len(hexes)}"),
        ("password: token: abcdefghij", ""),
        ("k = 'a1b2c3d4e5'\ndb_password = k", "lexed:5:15"),
        (None, ""), ("", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [got[i].spans for i in range(len(cases))] == [w for _, w in cases]
    assert got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(none).count() == 0


def test_secrets_in_wide_alignment(spark):
    cases = [f'db_pwd{" " * n}={chr(9) * n}"Xy12ab90Zq"' for n in (8, 9, 12, 60)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert got == {i: f"lexed:{c.index(chr(34)) + 1}:{len(c) - 1}" for i, c in enumerate(cases)}


def test_sharding(docs, none):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    rows = sharding.assign(docs).toPandas()
    assert len(rows) == docs.count()
    for r in rows.itertuples():
        key = 0 if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.shard == jump(key, 16) and r.grown_shard == jump(key, 17) and r.grown_shard in (r.shard, 16)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert sharding.assign(none).count() == 0


def test_language_id(spark):
    say = {"en": "the river and the stone of the light ", "de": "der fluss und die steine des lichtes ", "fr": "la rivière et les pierres de la lumière "}
    rows = [(k, t * (k % 5 + 1), lang, f"{lang}.example", 0) for lang, t in say.items() for k in range(20)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(98, None, None, None, None), (99, "\x01\x02\x03\x04" * 50, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash"))
    found = {r["__tl_row"].doc_id: r for r in language.identify(language.document_evidence(docs, F.struct("doc_id")), language.train(docs)).collect()}
    assert all(found[i].lang == rows[i][2] and found[i].accepted for i in range(60))
    assert not found[99].accepted
    kept = language.keep_known(docs)
    assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} >= set(range(60))
    assert language.keep_known(docs.limit(0)).count() == 0
    page = spark.createDataFrame([(1, "https://x.fr/fr/1", f'<html lang="fr"><p>{say["fr"] * 3}</p>')], "page_id long, url string, html string")
    assert language.identify(language.page_evidence(page, F.struct("page_id")), language.train(docs)).first().lang == "fr"


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice("abcdef") for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            words[5:9] = ["vilestword", "vilest", "vilesty", "vile"]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in range(600)]) > 0.97
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert got[4].held_out == (zlib.crc32(b"4") % 3 == 1)


def test_pii(spark, none):
    t = "Write A.Bell19@mail5.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, not 4111111111111112, 8.196.197.208. Frau Anna Schmidt met Mr. Joe Bell."
    rows = [(1, t, "en", "s", len(t)), (2, "again a.bell19@mail5.example.com", "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (1, t, "en", "s", len(t))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_entities": F.lit(5), "found": F.lit("x")})
    out = pii.stage(docs)
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    new = got[0].text
    for gone in ("A.Bell19", "017", "4111 1111 1111 1111", "8.196.197.208", "Anna", "Schmidt", "Joe"):
        assert gone not in new
    assert "4111111111111112" in new and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and "Frau " in new and got[0].text == got[1].text
    mail = re.search(r"\S+@\S+", new)[0]
    assert got[2].text == "again " + mail.lower() and got[3].text is None and got[4].text == "" and got[0].n_chars == len(new)
    digits = [int(c) for c in re.sub(r"\D", "", re.search(r"card ([\d ]+),", new)[1])][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert pii.replace(none).count() == 0


def test_pii_full_formats(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    raws = [f"{c}@x.com" for c in letters] + [f"+1{k:04}" for k in range(7000)] + [f"192.168.7.{k}" for k in range(99)]
    rows = pii.replacements(spark.createDataFrame([(r,) for r in raws], "raw string"), "k").collect()
    assert sorted(r.raw for r in rows) == sorted(raws)
    new = [r.new for r in rows]
    assert len(set(new)) == len(raws) and not set(new) & set(raws)
    assert {len(r.new) for r in rows if r.kind == "email"} == {7}
    phones = [n for n in new if n.startswith("+1")]
    assert len(phones) == 7000 and sorted(n for n in phones if len(n) == 6) == [f"+1{k:04}" for k in range(7000, 10000)]
    assert all(re.fullmatch(r"\+1\d{4,5}", n) for n in phones)


def test_pii_forms_of_a_name_stay_together(spark):
    surnames = [a + b + c for a in ("Ber", "Kol", "Tam", "Wun", "Zel") for b in ("di", "ro", "ma", "ku") for c in ("ck", "nd", "rt", "ss", "lm")]
    t = "Mr John {0} and Mrs {0} met Mr {0}. Later {0} left, John {0} stayed; John-Boy too."
    docs = spark.createDataFrame([(i, t.format(n), "en", "s", 1) for i, n in enumerate(surnames)], SCHEMA)
    rows = sorted(pii.replace(docs).collect(), key=lambda r: r.doc_id)
    found = [re.fullmatch(r"Mr (\w+) (\w+) and Mrs \2 met Mr \2\. Later \2 left, \1 \2 stayed; \1-Boy too\.", r.text) for r in rows]
    assert all(found) and all(r.n_entities == 6 for r in rows)
    assert len({m[2] for m in found}) == len(surnames) and len({m[1] for m in found}) == 1
    assert not {w for m in found for w in m.groups()} & {*surnames, "John"}


def test_pii_clashes_are_drawn_again(spark):
    found = spark.createDataFrame([(f"u{i}@mail.example.com",) for i in range(30)], "raw string")
    crowded = lambda s, kind, norm, attempt: F.concat(F.lit("n"), (F.abs(F.xxhash64(norm, attempt)) % 60).cast("string"), F.lit("@x.example.com"))
    rows = pii.replacements(found, "k", crowded).collect()
    assert len({r.new for r in rows}) == 30


def test_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_rows_are_not_shuffled_for_known_sizes(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("key"), "id")
    sizes = spark.createDataFrame([(0, 20), (1, 3)], "key long, __rows long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = groups.block_pairs(rows, ["key"], F.col("id"), 10, sizes)
        assert "hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
