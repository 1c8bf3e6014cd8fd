"""Rules, shards, mixing and fingerprints against plain Python, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from check import compare, connect
from scanlake.llm import divergence, jump_shards, mixing, registry, winnowing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in registry.QUERIES.items() if sql))
def test_query_matches_sql(spark, duck, name):
    fn, sql = registry.QUERIES[name]
    assert compare(spark, duck, name, fn, sql, SF) is None


def words(t):
    return (t or "").encode("utf-8", "surrogatepass").split()


def base_counts(t):
    w = [x.decode() for x in words(t)]
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def test_rules_base_counts(spark, odd, odd_rows):
    got = [tuple(r)[:7] for r in divergence.rate_documents(odd).collect()]
    assert collections.Counter(got) == collections.Counter((d, *base_counts(t)) for d, t, *_ in odd_rows)


def test_rules_reject_other_histograms_and_keep_the_rest(spark, odd):
    got = {r["doc_id"]: r["kept"] for r in divergence.rate_documents(odd).collect()}
    assert not got[14] and not got[12] and not got[2] and got[5] and got[8] and got[9]
    assert sum(got[100 + k] for k in range(40)) >= 36


def test_js_distance(spark):
    p, q = [1.0, 2.0, 0.0, 5.0], [2.0, 2.0, 4.0, 0.0]
    row = spark.createDataFrame([(p, q, [0.0] * 4)], "p array<double>, q array<double>, z array<double>")
    got = row.select(divergence.js_distance(row.p, row.q), divergence.js_distance(row.p, row.p), divergence.js_distance(row.p, row.z)).first()
    x, y = [v / sum(p) for v in p], [v / sum(q) for v in q]
    kl = lambda a, b: sum(u * math.log2(u / ((u + v) / 2)) for u, v in zip(a, b) if u)
    assert got[0] == pytest.approx(math.sqrt((kl(x, y) + kl(y, x)) / 2)) and got[1] == 0 and got[2] is None


def test_rules_stage_keeps_columns(spark, odd, nothing):
    kept = divergence.rules_stage(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema and 0 < kept.count() < odd.count()
    assert divergence.rules_stage(nothing).count() == 0 and divergence.rate_documents(nothing).count() == 0


def test_rules_stage_rejects_other_languages_and_gibberish(spark):
    rng = random.Random(8)
    common = {"en": "the of and to in is that for it as was with".split(), "fr": "le de et la les des un une du que au sur".split()}

    def prose(lang):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.24 else "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(300))

    rows = [(k, prose(lang), lang, "a") for k, lang in enumerate(["en", "fr"] * 40)]
    other = [(100 + k, t, {"en": "fr", "fr": "en"}[lang], s) for k, t, lang, s in rows[:4]]
    gibberish = [(200 + k, re.sub("[a-z]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), t), lang, s) for k, t, lang, s in rows[:4]]
    digits = [(300, " ".join(str(rng.random())[2:7] for _ in range(60)), "none", "a"), (301, None, "none", "a")]
    docs = spark.createDataFrame(rows + other + gibberish + digits, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in divergence.rules_stage(docs).collect()}
    assert kept == {r[0] for r in rows} | {300}


def test_long_words_are_common_words(spark):
    rng = random.Random(6)
    common = [f"gemeinsam{k:02d}" for k in range(24)]
    text = " ".join(w for k in range(100) for w in (common[k % 24], f"selten{rng.random()}"))
    foreign = " ".join(f"anders{rng.random()}" for _ in range(200))
    docs = spark.createDataFrame([(1, text, "x"), (2, foreign, "y"), (3, foreign, "x")], "doc_id long, text string, lang string")
    refs = {r["_lang"]: r for r in divergence.references(docs.where("doc_id < 3")).collect()}
    assert sorted(refs["x"]["_common"]) == common and refs["x"]["_word_ref"][-1] == 100 and len(refs["y"]["_common"]) == 24
    judged = {r["doc_id"]: r for r in divergence.judge(docs, divergence.references(docs.where("doc_id < 3"))).collect()}
    assert judged[1]["word_distance"] == 0 and judged[1]["kept"] and judged[3]["word_distance"] > 0.42 and not judged[3]["kept"]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark, odd, odd_rows, nothing):
    got = jump_shards.shard_documents(odd).collect()
    assert len(got) == len(odd_rows)
    slots = collections.defaultdict(list)
    for r in got:
        key = (r["doc_id"] or 0) % 2**64
        assert r["shard"] == jump(key, 24) and r["grown_shard"] == jump(key, 25) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows)
    assert jump_shards.shard_documents(nothing).count() == 0


def test_growth_moves_only_into_the_new_shard(spark):
    rows = jump_shards.assign(spark.range(-5000, 20_000).withColumnRenamed("id", "doc_id"), 24).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 24 for r in moved) and 0.03 < len(moved) / len(rows) < 0.05
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 1.15 * len(rows) / 24


def test_mixing(spark, odd, odd_rows, nothing):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == len(odd_rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_documents(odd).collect()), key=repr)
    by_doc = collections.Counter((r["doc_id"], r["size"]) for r in got)
    assert by_doc == collections.Counter((d, len(words(t))) for d, t, *_ in odd_rows)
    sources = collections.defaultdict(list)
    for _, t, _, s in odd_rows:
        sources[s].append(len(words(t)))
    order = sorted(s for s in sources if s is not None) + [None]
    weight = dict(zip(order, [5, 2, 1] * 9))
    size = {s: sum(v) for s, v in sources.items()}
    target, full = {}, set()
    while True:
        free = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else free * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert {(round(r["target"], 6), r["source_size"]) for r in got} == {(round(target[s], 6), size[s]) for s in order}
    for key in {(r["target"], r["source_size"]) for r in got}:
        mine = [r for r in got if (r["target"], r["source_size"]) == key]
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - key[0]) <= max(r["size"] for r in mine)
    assert mixing.mix_documents(nothing).count() == 0


def test_mix_stage_repeats_rows(spark, odd, nothing):
    mixed = mixing.mix_stage(odd)
    assert mixed.schema == odd.schema
    taken = sum(r["taken"] for r in mixing.mix_documents(odd).collect())
    assert sum(len(words(r["text"])) for r in mixed.collect()) == taken
    assert mixing.mix_stage(nothing).count() == 0


def select(t):
    w = words(t)
    if not w:
        return []
    h = []
    for i in range(max(len(w) - 3, 1)):
        seed = 42
        for x in w[i : i + 4]:
            seed = xxhash.xxh64_intdigest(x, seed)
        h.append(seed - 2**64 if seed >= 2**63 else seed)
    out = []
    for i in range(max(len(h) - 7, 1)):
        p = min(range(i, min(i + 8, len(h))), key=lambda j: (h[j] >> 30, -j))
        if not out or out[-1][0] != p:
            out.append((p, h[p]))
    return out


def like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("slice_", [1, 7, 1024])
def test_winnowing(spark, odd, odd_rows, slice_, monkeypatch):
    monkeypatch.setattr(winnowing, "SLICE", slice_)

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return row[0] is not None, row[0] or 0, h - 2**64 if h >= 2**63 else h

    rows = sorted([(d, t or "") for d, t, *_ in odd_rows], key=place)  # null ids and repeated ids by the hash of their text
    got = collections.Counter(map(tuple, winnowing.fingerprint_documents(odd).collect()))
    want = collections.Counter()
    for k, (d, t) in enumerate(rows):
        n, following = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + following[: n // 2]
        mine, changed = select(t), select(edited)
        text = lambda g: " ".join(f"{p}:{h % 2**64:x}" for p, h in g)
        want[d, n, hashlib.sha256(edited.encode()).hexdigest(), text(mine), text(changed), like(mine, changed), like(mine, select(following))] += 1
    assert got == want


def test_winnowing_null_ids_in_slices_by_hash(spark):
    docs = spark.createDataFrame([(None, f"word{k} and more of it") for k in range(300)] + [(1, "one")], "doc_id long, text string")
    every, _ = winnowing.in_slices(docs)
    assert every.where("doc_id IS NULL AND NOT copy").select("slice").distinct().count() > 100
    rows = sorted(([r["text"] for r in docs.where("doc_id IS NULL").collect()]), key=lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), 42)))
    following = dict(zip(rows, [*rows[1:], "one"])) | {"one": rows[0]}
    got = collections.Counter(r["edited_sha256"] for r in winnowing.fingerprint_documents(docs).collect())
    assert got == collections.Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in following.items())


def test_winnowing_keeps_every_row(spark, odd, odd_rows, nothing):
    got = winnowing.fingerprint_documents(odd).collect()
    assert len(got) == len(odd_rows) and len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert winnowing.fingerprint_documents(nothing).count() == 0
    alone = winnowing.fingerprint_documents(odd.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_winnowing_guarantee():
    a = [f"w{k}" for k in range(200)]
    b = [f"v{k}" for k in range(90)] + a[50 : 50 + 11] + [f"u{k}" for k in range(90)]
    assert {h for _, h in select(" ".join(a))} & {h for _, h in select(" ".join(b))}
