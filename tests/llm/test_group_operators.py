"""Near-duplicates, repeated passages, packing, counts, classifiers and the pipeline against plain Python."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brute_force import near_classes, removed_words
from check import connect
from scanlake.llm import components, divergence, edit_counts, mixing, packing, pairwise_quality, phrases, probminhash, toxicity_chain

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_probability_jaccard():
    rng = random.Random(3)
    for _ in range(40):
        a, b = ({k: rng.choice([1, 1, 2, 5]) for k in rng.sample(range(12), rng.randint(1, 12))} for _ in range(2))
        every = set(a) | set(b)
        want = sum(1 / sum(max(a.get(f, 0) / a[e], b.get(f, 0) / b[e]) for f in every) for e in set(a) & set(b))
        sides = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert probminhash.probability_jaccard(*sides) == pytest.approx(want)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for shared in (20, 100, 180):
        x, y = rng.integers(0, 2**40, 200, dtype=np.uint64), rng.integers(0, 2**40, 200, dtype=np.uint64)
        y[:shared] = x[:shared]
        sides = [(np.sort(v), np.ones(len(v))) for v in (x, y)]
        owner = np.repeat([0, 1], 200)
        z = probminhash.signatures(owner, np.concatenate([s[0] for s in sides]), np.ones(400), 2)
        errors.append((z[0] == z[1]).mean() - probminhash.probability_jaccard(*sides))
    assert max(map(abs, errors)) < 0.15


def test_near_duplicates_match_all_pairs(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()}
    assert got == near_classes(pairs_of(docs))


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """One original with many edits of it, compared in small blocks."""
    monkeypatch.setattr(probminhash, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([2, 5, 9, 30])):
            w[rng.randrange(400)] = f"x{d}_{rng.random()}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, text) for d, text in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()}
    assert got == near_classes(rows)


def test_near_duplicates_on_odd_rows(spark, odd, odd_rows, nothing):
    got = probminhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["class_id"])
    assert by_id[5] == by_id[6] == by_id[7] == {5} and by_id[1] == by_id[2] and by_id[3] == {3}
    assert probminhash.near_duplicates(nothing).count() == 0
    kept = probminhash.keep_one(odd)
    assert kept.schema == odd.schema and kept.count() == len({r["root"] for r in got}) and probminhash.keep_one(nothing).count() == 0


def test_keep_one_keeps_the_smallest_id_of_each_class(spark):
    docs = documents(spark)
    rows = pairs_of(docs)
    wanted = set(near_classes(rows).values())
    assert len(wanted) < len(rows)
    assert sorted(pairs_of(probminhash.keep_one(docs))) == sorted((d, t) for d, t in rows if d in wanted)


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(1000, 1001), (7, 7)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("shard, group", [(20_000, 1_000_000), (5, 400)])
def test_repeats(spark, odd, odd_rows, monkeypatch, shard, group):
    monkeypatch.setattr(phrases, "SHARD_PHRASES", shard)
    monkeypatch.setattr(phrases, "GROUP_WORDS", group)
    rng = random.Random(9)
    rows = [(d, t) for d, t, *_ in odd_rows if d is not None]
    pool = [" ".join(f"p{k}_{i}" for i in range(60)) for k in range(4)]
    for d in range(300, 360):
        rows.append((d, " ".join([*(f"q{rng.random()}" for _ in range(rng.randint(0, 60))), *rng.sample(pool, 2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in phrases.remove_repeats(docs).collect())
    want = collections.Counter()
    for d, kept, n in removed_words(rows):
        want[(d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert got == want


def test_only_windows_found_earlier_are_stored(spark, monkeypatch):
    """Of the windows of a split shard those go to the disk that another part has earlier: each is moved once to find them."""
    monkeypatch.setattr(phrases, "GROUP_WORDS", 400)
    kept, stored = {}, phrases.text.stored
    monkeypatch.setattr(phrases.text, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([*(f"q{d}_{i}" for i in range(40)), *passage])) for d in range(30)]
    with phrases.text.scratch():
        _, _, cuts = phrases._find(spark.createDataFrame(rows, "doc_id long, text string"))
        windows = [(r["part"], r["a"], r["b"], r["first"]) for r in kept["windows"].collect()]
        assert cuts.count() == 29
    assert windows and {w[3] for w in windows} == {0} and len(windows) == 11 * len({w[0] for w in windows})


def test_repeats_stage(spark, odd, odd_rows, nothing):
    out = phrases.phrases_stage(odd)
    assert out.schema == odd.schema and out.count() == len(odd_rows)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    old = {r[0]: r[1] for r in odd_rows}
    assert text[5] == old[5] and text[6] == "" and text[8] == old[8] and text[9] == " ".join(old[9].split("\n")[1].split()) and text[1] is None
    assert phrases.phrases_stage(nothing).count() == 0 and phrases.remove_repeats(nothing).count() == 0


def test_packing(spark, odd, odd_rows, nothing):
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for d, t, *_ in odd_rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want[(d, i // 2048, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = packing.pack_documents(odd).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    inside = collections.defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= 2048
    assert len(inside) <= 1 + -(-sum(r["length"] for r in rows) // 2048) and packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum((rng.lognormal(rng.uniform(1, 7), 1.3, 3000)).astype(int) + 1, 2048)
    if seed == 5:
        lengths = np.full(3000, 700)
    counts, used = np.bincount(lengths, minlength=2049), np.zeros(2049, int)
    plan = packing.plan_sequences(counts)
    for pattern, times in plan:
        assert sum(a * b for a, b in pattern) <= 2048 and times > 0
        for a, b in pattern:
            used[a] += b * times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= (1500 if seed == 5 else 1.02 * lengths.sum() / 2048 + 1)


def test_edited_counts(spark, odd, odd_rows, nothing):
    path = edit_counts.tokenizer_path()
    full = edit_counts.counter(path).encoding.encode_ordinary
    got = collections.Counter((r["doc_id"], r["n_before"], r["n_after"], r["n_chars_after"]) for r in edit_counts.count_edited(odd).collect())
    want = collections.Counter()
    for d, t, *_ in odd_rows:
        t = t or ""
        n = len(t)
        e = t[: n // 3] + t[:20] + t[min(n // 3 + 40, n) :]
        e = "Title: " + e
        e = e[: 2 * n // 3] + e[2 * n // 3 + 15 :]
        want[(d, len(full(t)), len(full(e)), len(e))] += 1
    assert got == want and edit_counts.count_edited(nothing).count() == 0


def test_edits_one_by_one():
    counts = edit_counts.counter(edit_counts.tokenizer_path())
    rng = random.Random(4)
    pieces = [" ", "\n", "\n\n  x", " 12ab", "", "é!", "\x1c", "  ", "word", "'s it's", "　", " y"]
    for t in ["", " ", "a", " tail  ", "the cat " * 300, "!!" * 90, "a\n\n" * 200]:
        tree = edit_counts.Tree.build(t, counts)
        for _ in range(40):
            t, _ = tree.edit(t, rng.randint(0, len(t) + 3), rng.choice([0, 1, 3, 40, 10_000]) if rng.random() < 0.9 else 5, "".join(rng.choices(pieces, k=rng.randint(0, 5))), counts)
            assert tree.chars[1] == len(t) and tree.tokens[1] == len(counts.encoding.encode_ordinary(t))


def test_edits_table(spark):
    path = edit_counts.tokenizer_path()
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 4, None), (1, 1, 3, 0, " more")], "doc_id long, seq int, start int, length int, replacement string")
    got = {r["doc_id"]: r for r in edit_counts.apply_edits(edit_counts.with_edits(edit_counts.build_trees(docs, path), edits), path).collect()}
    assert got[1]["text"] == "more two three" and got[1]["n_edits"] == 2 and got[2]["n_edits"] == 0 and got[2]["tokens"][1] == 0


def labelled(spark, name):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_held_out(spark):
    docs, labels = labelled(spark, "quality")
    scores = pairwise_quality.score_documents(docs, labels).toPandas()
    rows = scores.merge(labels.toPandas(), on="doc_id")
    rows = rows[rows.held_out]
    assert len(scores) == docs.count() and scores.score.between(0, 1).all() and ((scores.score >= 0.7) == (scores.predicted == 1)).all()
    assert (scores.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in scores.doc_id]).all()
    assert (rows.predicted == rows.quality).mean() > 0.93


def test_ranking_equals_a_plain_fit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    better = x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.7, size=400) > 0.2
    model = pairwise_quality.fit(x, better, pairs=2000, ridge=1e-2, seed=3)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    z = np.concatenate((z, z * z), axis=1)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(better), 2000)] - z[draw.choice(np.flatnonzero(~better), 2000)]
    w = np.zeros(6)
    for _ in range(20_000):  # plain descent on the mean loss of log(1 + exp(-difference)) and the ridge
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-2 * w)
    assert np.allclose(model.weight, w, atol=1e-5) and model.threshold == pytest.approx(np.quantile(z @ w, (~better).mean()), abs=1e-4)
    assert (model.score(x) >= 0.7).mean() == pytest.approx(better.mean(), abs=0.01)


def test_term_evidence_is_out_of_fold():
    slots = [np.array(s, np.int32) for s in ([1, 2], [1, 2], [1, 3], [1, 3], [4], [], [4, 5], [4], [4], [1])]
    better = np.array([1, 1, 1, 1, 0, 1, 0, 0, 0, 1], bool)
    sample = pairwise_quality.Sample(np.zeros((10, len(pairwise_quality.features.NUMBERS))), slots, better, np.arange(10) % 5)
    x, odds = sample.inputs()

    def plain(rows, s):
        with_terms = [k for k in rows if len(slots[k])]
        n, inside = sum(s in slots[k] for k in rows), sum(s in slots[k] and better[k] for k in rows)
        good = sum(better[k] for k in with_terms)
        return np.log((inside + 0.5) / (good + 1)) - np.log((n - inside + 0.5) / (len(with_terms) - good + 1)) if n >= 3 else 0.0

    assert np.allclose(odds[:6], [plain(range(10), s) for s in range(6)]) and odds[1] > 1 > -1 > odds[4]
    for k, s in enumerate(slots):
        own = [plain([j for j in range(10) if j % 5 != k % 5], t) for t in s]
        assert np.allclose(x[k, -3:], [np.mean(own), np.mean([v > 1 for v in own]), np.mean([v < -1 for v in own])] if len(s) else 0)


def test_quality_ignores_held_out_labels(spark):
    docs, labels = labelled(spark, "quality")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one, two = (pairwise_quality.score_documents(docs, x).toPandas().sort_values("doc_id") for x in (labels, flipped))
    assert (one.score.to_numpy() == two.score.to_numpy()).all()


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "toxic")
    rows = toxicity_chain.classify_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    rows = rows[rows.held_out]
    assert (rows.toxic == rows.toxic_label).mean() > 0.92 and rows[rows.toxic_label == 0].toxic.mean() < 0.03
    assert rows[rows.quality == 0].p_low_quality.mean() > 2 * rows[rows.quality == 1].p_low_quality.mean()


def test_classifiers_on_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0), "x") for k in range(100, 140)] + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    for docs, marks in ((odd, labels), (odd, labels.where("false")), (odd, labels.where("quality = 1 AND toxic = 0"))):
        assert pairwise_quality.score_documents(docs, marks).count() == len(odd_rows)
        assert toxicity_chain.classify_documents(docs, marks).count() == len(odd_rows)
    assert pairwise_quality.score_documents(nothing, labels).count() == 0 and toxicity_chain.classify_documents(nothing, labels).count() == 0


def test_pipeline(spark):
    docs = documents(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = after.checkpoint()
        assert before.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "repeated_passages", "mix_sources", "pack_sequences"]


def test_hits_of_the_automaton_alone_name_candidates(monkeypatch):
    rng = random.Random(12)
    one, two = ([f"{x}{rng.randint(0, 999)}" for _ in range(60)] for x in "pq")
    texts = [" ".join([*one, *[f"a{k}" for k in range(30)], *two]), " ".join([*[f"b{k}" for k in range(40)], *two, *one])]
    chosen = []
    for t in texts:
        h, counts = phrases.hashed([t])
        data = phrases.letters(h).tobytes()
        chosen.append({data[2 * p : 2 * (p + phrases.PHRASE)] for p in phrases.positions(h, counts).tolist()})
    shared = sorted(chosen[0] & chosen[1])
    first = [x for x in shared if x in phrases.letters(phrases.hashed([" ".join(one)])[0]).tobytes()]
    assert first and len(first) < len(shared)
    others = pd.DataFrame({"a": [], "b": [], "first": []})

    def ranges(known):
        pdf = pd.DataFrame({"node": [b"1", b"2"], "rep": [1, 2], "phrases": [known, known], "text": texts})
        return {r.node: r.ranges for r in phrases.judge(pdf, others).itertuples()}

    assert ranges(shared) == {b"2": [[40, 160]]} or ranges(shared) == {b"2": [[40, 100], [100, 160]]}
    assert ranges(first) == {b"2": [[100, 160]]} and ranges([]) == {}
    compiled = phrases.automaton_of
    monkeypatch.setattr(phrases, "automaton_of", lambda known: compiled([b"\x01\x00"]))
    assert ranges(shared) == {}


def test_pipeline_equals_plain_stages(spark):
    """``run`` against SQL for the rules and the mix, and plain Python for near copies, passages and pieces."""
    import duckdb

    con = connect(SF)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({divergence.OP2_SQL}) WHERE kept").fetchall()}
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in documents(spark).collect() if r["doc_id"] in kept}
    assert 0 < len(rows) < documents(spark).count()
    firsts = set(near_classes([(d, t) for d, (t, _) in rows.items()]).values())
    rows = {d: v for d, v in rows.items() if d in firsts}
    before = {d: t for d, (t, _) in rows.items()}
    for d, words, n in removed_words(list(before.items())):
        if len(words) < n:
            rows[d] = (b" ".join(words).decode(), rows[d][1])
    assert any(rows[d][0] != before[d] for d in rows)
    plain = pd.DataFrame([(d, t, s) for d, (t, s) in rows.items()], columns=["doc_id", "text", "source"])
    mix = duckdb.connect()
    mix.register("documents", plain)
    times = {d: taken // size if size else 0 for d, size, taken in mix.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP6_SQL})").fetchall()}
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for d, (t, _) in rows.items():
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times[d]
    got, places = collections.Counter(), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == +want
    for pieces in places.values():
        pieces.sort()
        ends = list(itertools.accumulate(n for _, n in pieces))
        assert [at for at, _ in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
