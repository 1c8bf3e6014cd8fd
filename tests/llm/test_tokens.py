"""Byte-level encoding and tokenizer alignment against the tokenizer libraries themselves."""

import base64
import bisect
import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from scanlake.llm import byte_bpe, token_alignment

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.tokenizer_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(encoding, t):
    ids = encoding.encode_ordinary(t or "")
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())


def test_round_trip_equals_the_library(spark, odd, odd_rows, encoding):
    for size, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 8)):
        got = collections.Counter(map(tuple, byte_bpe.round_trip(odd, size=size, overlap=overlap).collect()))
        assert got == collections.Counter((d, *expected(encoding, t)) for d, t, *_ in odd_rows)


def test_query_equals_the_library(spark, encoding):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.op12_overlapping_chunks(spark, SF).collect()}
    assert got == {d: expected(encoding, t) for d, t in docs.items()}


def test_odd_characters_and_long_runs_in_small_chunks(spark, encoding):
    rng = random.Random(4)
    pool = "ab'sre ll \n\t  1٣Ⅷé'ß漢字，。!#  　\x1c\x85\U0001f600\U0001d4b3\U00010410՘\U00031350"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["a" * 5000, " " * 3000 + "x", "x " + "\n" * 2000, "!?" * 2000, "'re" * 900, "1" * 700 + " b" * 300, ("z" * 300 + " ") * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = byte_bpe.encode_documents(docs, size=20, overlap=4)
    got = collections.defaultdict(dict)
    for r in parts.collect():
        got[r["doc_id"]][r["part"]] = r["ids"]
    for d, t in enumerate(texts):
        assert [i for _, ids in sorted(got[d].items()) for i in ids] == encoding.encode_ordinary(t)
    assert max(map(len, got.values())) > 10
    decoded = collections.defaultdict(dict)
    for r in byte_bpe.decode_ids(parts).collect():
        decoded[r["doc_id"]][r["part"]] = bytes(r["bytes"])
    assert [b"".join(v for _, v in sorted(decoded[d].items())).decode() for d in range(len(texts))] == texts


def test_chunks_overlap_and_readings_meet():
    splitter = byte_bpe.codec(byte_bpe.tokenizer_path()).splitter
    t = "one don't " + "x" * 50 + " y, z 12ab" * 10
    chunks = list(splitter.cut(t, 16, 4))
    assert all(t[start : start + len(part)] == part for _, start, _, _, part in chunks) and sum(start for _, start, *_ in chunks) > 0
    for (_, a, _, tail, part), (_, b, head, _, _) in zip(chunks, chunks[1:]):
        assert head == tail == a + len(part) - b > 0
    assert chunks[0][2] == chunks[-1][3] == 0 and splitter.split("") == []


def test_encode_empty_table(spark, nothing):
    assert byte_bpe.round_trip(nothing).count() == 0
    empty = byte_bpe.encode_documents(nothing)
    assert empty.columns == ["doc_id", "part", "ids"] and byte_bpe.decode_ids(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = token_alignment.tokenizer_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=b_path)
    names = {i: name for name, i in a.get_vocab().items()}
    plain = [x for x in range(256) if chr(x).isprintable() and x not in (0x20, 0xA0, 0xAD)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def both(t):
        """(ids of A, ids of B, bytes of each of their tokens), from the whole text at once."""
        a_ids, b_ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        return a_ids, b_ids, [bytes(byte[c] for c in names[i]) for i in a_ids], b_bytes

    return both


def spans(tokens):
    ends = list(itertools.accumulate(map(len, tokens)))
    return list(zip([0, *ends], ends))


def aligned(tokenizers, texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared), by comparing byte ranges."""
    found = []
    for t in texts:
        x = tokenizers(t) if t else None
        if x is None or b"".join(x[2]) != (" " + t).encode() or b"".join(x[3]) != (" " + t).encode():
            found.append(None)
            continue
        a_ids, b_ids, a, b = x
        p, q = spans(a), spans(b)
        links, low = [], 0
        for i, (s, e) in enumerate(p):
            while q[low][1] <= s:
                low += 1
            links += [(i, j) for j in itertools.takewhile(lambda j: j < len(q) and q[j][0] < e, itertools.count(low))]
        cuts = sorted({e for _, e in p} & {e for _, e in q})
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a_ids, p), (1, b_ids, q)):
            for i, (_, e) in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        found.append((a_ids, b_ids, links, groups))
    counts = collections.Counter((x[0][i], x[1][j]) for x in found if x for i, j in x[2])
    highest = collections.Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    for x in found:
        if x is None:
            yield (0, 0, 0, 0, 0, 0, "", 0)
            continue
        a_ids, b_ids, links, groups = x
        n = [counts[a_ids[i], b_ids[j]] for i, j in links]
        best = sum(k == highest[b_ids[j]] for k, (_, j) in zip(n, links))
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (len(a_ids), len(b_ids), len(groups), len(links), best, sum(n), sha(line.encode()), sum(len(g) * len(h) for g, h in groups))


@pytest.mark.parametrize("broadcast_pairs", [token_alignment.BROADCAST_PAIRS, 5])
def test_alignment_equals_byte_ranges(spark, odd, odd_rows, tokenizers, broadcast_pairs):
    got = collections.Counter(map(tuple, token_alignment.align_documents(odd, broadcast_pairs=broadcast_pairs).collect()))
    assert got == collections.Counter((r[0], *x) for r, x in zip(odd_rows, aligned(tokenizers, [r[1] for r in odd_rows])))


def test_alignment_of_odd_characters(spark, tokenizers):
    rng = random.Random(6)
    pool = "ab'sre ll \n\t  1٣\xe9'\xdf漢字，.!#\xa0 　\x85\U0001f600\U0001d4b3\r\x00<s>|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    texts += ["<|endoftext|> <s> <0x0A>", "a▁b", "▁", " ", "  x ", "a" * 3000, " " * 500, "\xa0  word", "\n", "x ﬁ é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.align_documents(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(aligned(tokenizers, texts))


def test_alignment_query_and_its_links(spark, tokenizers):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.op13_incidence_products(spark, SF).collect()}
    assert got == dict(zip(docs, aligned(tokenizers, docs.values())))
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20")
    links = token_alignment.token_links(table).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in links} == {d: got[d][3] for d in range(20)}
    shared = token_alignment.token_links(table, shared=True).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in shared} == {d: got[d][7] for d in range(20)}
    counts = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in token_alignment.pair_counts(table).collect()}
    own = collections.Counter((r["a_id"], r["b_id"]) for r in token_alignment.token_links(table).collect())
    assert {k: n for k, (n, _) in counts.items()} == own and any(not best for _, best in counts.values())


def test_alignments_are_kept_by_use(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_LETTERS", 400)
    s = token_alignment.Segments(token_alignment.Aligner(*token_alignment.tokenizer_paths()))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    fresh = token_alignment.Segments(s.aligner)
    for k in range(40):
        texts = [" ".join([*rng.choices(words[:10], k=20), *rng.choices(words, k=10)]) for _ in range(3)]
        (codes, first, good), (other, _, _) = s.texts(texts), fresh.texts(texts)
        assert good.all() and np.array_equal(s.stats[codes], fresh.stats[other]) and [s.groups[c] for c in codes] == [fresh.groups[c] for c in other]
        links = [[x.links[x.start[c] : x.start[c + 1]].tolist() for c in y] for x, y in ((s, codes), (fresh, other))]
        assert links[0] == links[1]
        if s.letters > 400:
            s.shrink()
            assert s.letters <= 200 and len(s.index) == len(s.groups)
    assert sum(w in s.index for w in words[:10]) >= 8


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(30):
        p, q = rng.random((rng.integers(1, 9), 7)) < 0.4, rng.random((7, rng.integers(1, 9))) < 0.4
        a, b = (token_alignment.Csr.of_rows(m.sum(1), np.nonzero(m)[1], m.shape[1]) for m in (p, q))
        dense = p.astype(int) @ q.astype(int)
        for most in (1, 5, 1000):
            got = np.zeros_like(dense)
            for r, c, v in a.products(b, most):
                got[r, c] += v
            assert np.array_equal(got, dense)
        assert np.array_equal(a.times(np.arange(7)), p.astype(int) @ np.arange(7))
        back = b.transpose()
        assert np.array_equal(np.sort(back.columns[back.start[0] : back.start[1]]), np.nonzero(q[:, 0])[0])


def test_align_empty_table(spark, nothing):
    assert token_alignment.align_documents(nothing).count() == 0 and token_alignment.token_links(nothing).count() == 0
