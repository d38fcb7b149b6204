"""Byte-level BPE, packing, token files, embeddings, URL filters and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import best_fit_packing, byte_bpe, embedding_dedup, token_file, url_filter
from tideline.llm._pieces import WholeTextCoder, library_coder, merges_in_order

from .edges import awkward, frame, key

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    rng = np.random.default_rng(8)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "e\u0301", "J\u030c", "19", "!", "İ", "Σ", "ς", "\x1c", "\r\n", "中", "<|endoftext|>", "\x85", "😀", "\u00a0"]
    return ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(1500)] + [t for _, t, _, _ in awkward() if t is not None]


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_pieces_equal_the_library(path, spaced):
    coder, whole = library_coder(path, spaced), library(path)
    texts = odd_texts()
    for cache in (1, 280 << 20):
        coder.cache_bytes = cache
        got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 500) for x in coder.encode([t.encode() for t in texts[k : k + 500]])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_texts_equal_the_library():
    coder, whole = WholeTextCoder(BYTES), library(BYTES)
    texts = [*odd_texts(), "x" + " " * 2000 + "y", "\n" * 5000, "é" * 3000, "a" * 20_000, "\u0240\u0370"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward() + [(100 + k, t, None, None) for k, t in enumerate(odd_texts()[:300])]
    want = sorted((key(i), plain.encode_ordinary(t or "")) for i, t, _, _ in rows)
    got = byte_bpe.byte_bpe(frame(spark, rows), RANKS).collect()
    assert sorted((key(r.doc_id), r.ids) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    texts = defaultdict(set)
    for i, t, _, _ in rows:
        texts[i].add(t or "")
    assert all(r.decoded.decode() in texts[r.doc_id] for r in got)
    again = byte_bpe.decode_ids(spark.createDataFrame([(1, plain.encode_ordinary("a bc é")), (2, None)], "doc_id long, ids array<int>"), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in again.collect()} == {1: "a bc é", 2: ""}
    assert byte_bpe.byte_bpe(spark.createDataFrame([], EMPTY), RANKS, digests=True).count() == 0
    bpe = byte_bpe.ByteBpe(RANKS)
    for word in ("ab" * 400, "=" * 700, "日本" * 200):
        assert np.frombuffer(bpe.contract([word.encode()])[0], "<u4").tolist() == plain._core_bpe.encode_single_piece(word.encode())


def test_sum_of_squares_fills_and_chooses():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 101, 400), np.full(50, 50), np.full(9, 100), np.array([60, 40, 60, 40])):
        bins, offsets = best_fit_packing.sum_of_squares(sizes, 100)
        for b in np.unique(bins):
            inside = np.flatnonzero(bins == b)
            inside = inside[np.argsort(offsets[inside])]
            assert offsets[inside].tolist() == np.concatenate([[0], np.cumsum(sizes[inside])[:-1]]).tolist() and sizes[inside].sum() <= 100
    order = np.sort(rng.integers(1, 101, 3000))[::-1]
    assert best_fit_packing.sum_of_squares(order, 100)[0].max() + 1 <= 1.04 * order.sum() / 100 + 2


def test_each_placement_minimises_the_squares():
    sizes = np.random.default_rng(3).integers(1, 20, 120)
    bins, offsets = best_fit_packing.sum_of_squares(sizes, 20)
    gaps = {}
    for n, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def squares(state):
            counts = defaultdict(int)
            for g in state.values():
                counts[g] += g > 0
            return sum(c * c for c in counts.values())

        choices = [squares(gaps | {c: g - n}) for c, g in gaps.items() if g >= n] + [squares(gaps | {"new": 20 - n})]
        assert at == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - n
        assert squares(gaps) == min(choices)


def check_packing(rows, docs, length, whole):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append(r)
    for inside in pieces.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    want = []
    for i, t, *_ in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        want += [(key(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(pieces)


def test_best_fit_packing(spark, monkeypatch):
    docs = awkward()
    monkeypatch.setattr(best_fit_packing.pack, "__defaults__", (best_fit_packing.LENGTH, 6))
    for length in (2048, 64):
        rows = best_fit_packing.best_fit_packing(frame(spark, docs), BYTES, length, with_ids=True).collect()
        check_packing(rows, docs, length, library(BYTES))
        assert all(len(r.ids) == r.length for r in rows)
    assert best_fit_packing.best_fit_packing(spark.createDataFrame([], EMPTY), BYTES).count() == 0


@pytest.mark.parametrize(("batch_rows", "shard_bytes", "largest"), [(256, 64 << 20, 49_000), (3, 9_000, 70_000)])
def test_token_files(spark, tmp_path, monkeypatch, batch_rows, shard_bytes, largest):
    monkeypatch.setattr(token_file, "BATCH_ROWS", batch_rows)
    monkeypatch.setattr(token_file, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(token_file, "largest_id", lambda _: largest)
    docs, whole = awkward(), library(WORDS)
    written = token_file.write_token_files(frame(spark, docs), WORDS, f"file://{tmp_path}/t", length=32).persist()
    rows = token_file.read_documents(written, f"file://{tmp_path}/t").orderBy("start").collect()
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((key(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _, _ in docs)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and written.count() > (4 if shard_bytes < 10_000 else 1)
    for part in written.collect():
        sequences, listed = token_file.read_shard(f"file://{tmp_path}/t", part.shard)
        run = np.concatenate([sequences[k][0] for k in range(len(sequences))])
        masks = np.concatenate([sequences.mask(k) for k in range(len(sequences))])
        assert masks.sum() == part.tokens == sum(listed.column("n_tokens").to_pylist()) and masks[: part.tokens].all()
        for a, b in ((0, part.tokens), (part.tokens // 3, part.tokens // 2), (part.tokens - 1, part.tokens), (5, 5)):
            assert sequences.ids(a, b).tolist() == run[a:b].tolist()
        with pa.ipc.open_stream(f"{tmp_path}/t/shard-{part.shard:06d}.arrows") as stream:
            assert stream.read_all().column("ids").combine_chunks().flatten().to_pylist() == run.tolist()
        got, mask = sequences[0]
        assert not got.flags.owndata and not mask.flags.owndata and len(got) == 32 and got.dtype.itemsize == (2 if largest < 1 << 16 else 4)
        with open(f"{tmp_path}/t/shard-{part.shard:06d}.arrows", "rb") as plain:  # not mapped
            assert token_file.SequenceFile(pa.PythonFile(plain))[len(sequences) - 1][0].tolist() == sequences[len(sequences) - 1][0].tolist()
        with pytest.raises(IndexError):
            sequences[len(sequences)]
    empty = token_file.write_token_files(spark.createDataFrame([], EMPTY), WORDS, f"file://{tmp_path}/e")
    assert empty.count() == 0 and token_file.read_documents(empty, f"file://{tmp_path}/e").count() == 0


def test_ids_that_do_not_fit_are_an_error():
    sink = pa.BufferOutputStream()
    writer = token_file.SequenceWriter(sink, 4, wide=False)
    writer.add(np.array([1, 70_000], "<u4").tobytes())
    with pytest.raises(OverflowError):
        writer.close()
    nothing = pa.BufferOutputStream()
    token_file.SequenceWriter(nothing, 4, wide=True).close()
    assert len(token_file.SequenceFile(pa.BufferReader(nothing.getvalue()))) == 0
    assert token_file.largest_id(WORDS) < 1 << 16


def test_order_of_merges_is_checked():
    assert merges_in_order({"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["a b", ["ab", "b"]]})
    assert not merges_in_order({"vocab": {"a": 0, "b": 1, "ab": 3, "bb": 2}, "merges": ["a b", "b b"]})
    assert not merges_in_order({"vocab": {"a": 0, "b": 5, "ab": 2}, "merges": ["a b"]})
    assert WholeTextCoder(BYTES).ordered


def plain_links(rows, threshold):
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    for k, (i, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None), default=None)
        yield key(i), n[k], key(None if i is None else least), i is not None and i == least


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, 16))
    rows = []
    for k in range(n):
        v = (centres[rng.integers(0, len(centres))] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist()
        rows.append((k, v, int(rng.integers(0, 2))))
    same = rows[0][1]
    rows += [(n + k, same, rows[0][2]) for k in range(20)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3, [1e30] * 16, [2e30] * 16]
    rows += [(n + 100 + k, v, 0) for k, v in enumerate(odd)] + [(n + 200, same, None), (None, same, rows[0][2])]
    return rows


@pytest.mark.parametrize(("leaf", "block"), [(256, 2048), (8, 12)])
def test_embedding_dedup(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(300)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, id string, links string")
    got = embedding_dedup.embedding_dedup(table).collect()
    assert sorted((key(r.vec_id), r.n_links, key(r.component_id), r.kept) for r in got) == sorted(plain_links(rows, 0.93))
    assert embedding_dedup.embedding_dedup(table.limit(0)).count() == 0


def test_every_vector_length_is_compared(spark):
    rng = np.random.default_rng(3)
    rows = []
    for dim in range(2, 72):
        v = rng.standard_normal(dim)
        rows += [(len(rows) + k, x.astype(np.float32).tolist(), 1) for k, x in enumerate((v, v * 2 + 0.01 * rng.standard_normal(dim), rng.standard_normal(dim)))]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((key(r.vec_id), r.n_links, key(r.component_id), r.kept) for r in got) == sorted(plain_links(rows, 0.93))
    assert all(r.n_links >= 1 for r in got if r.vec_id % 3 < 2)


def test_large_leaves_are_split_again(spark, monkeypatch):
    """Leaves deeper than the sample allows, and a knot of vectors that no cut parts."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "LEAF_SAMPLE", 60)
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(24).astype(np.float32).tolist(), 0) for k in range(500)]
    knot = rng.standard_normal(24)
    rows += [(1000 + k, (knot + 0.02 * rng.standard_normal(24)).astype(np.float32).tolist(), 0) for k in range(90)]
    splits, plain = [], embedding_dedup._refined
    monkeypatch.setattr(embedding_dedup, "_refined", lambda *a: splits.append(plain(*a)) or splits[-1])
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), sample=40).collect()
    assert sorted((key(r.vec_id), r.n_links, key(r.component_id), r.kept) for r in got) == sorted(plain_links(rows, 0.93))
    assert len(splits) >= 2 and splits[-1] is None


def test_forest_routes_to_leaves_and_finds_neighbours():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    y = x + 0.05 * rng.standard_normal(x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    forest = embedding_dedup.fit_forest([x[:2000]], 6, 0.93)
    met = np.zeros(len(x), bool)
    for tree in range(embedding_dedup.TREES):
        leaves = [defaultdict(set), defaultdict(set)]
        for side, v in zip(leaves, (x, y), strict=True):
            for row, leaf in zip(*forest.route(v, tree), strict=True):
                assert 0 <= leaf < forest.leaves
                side[row].add(leaf)
        met |= [bool(leaves[0][k] & leaves[1][k]) for k in range(len(x))]
    assert met.mean() > 0.999


def test_url_filter(spark):
    rows = [
        (1, "http://a.b.net/x"), (2, "http://example.net/en/x"), (3, "https://www.EXAMPLE.net/en/?q"), (4, "http://example.net/de"), (5, "http://example.com/de/1"), (6, "http://notexample.com/de/1"),
        (7, "https://x.org/fr/"), (8, "https://x.org/fr"), (9, "http://net/"), (10, "http://net"), (11, None), (12, "no scheme"), (13, "ftp://HOST.org?x://y/z"), (14, "http://h.org/a?b#c"), (15, "://"), (16, "http://h.org#/p"), (1, "http://a.b.net/x"),
        (None, "http://freecasinobets.org/en/"), (18, "http://cheappillsonline.example.org/"), (19, "http://m.ads-track.example.com/en/5"), (20, "http://citylibrarynews.example.org/en/5"), (21, "http://Énet.org/Ünet/"),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, words string")
    got = url_filter.url_filter(table).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    rules = {1: "net/", 2: "example.net/en/", 3: "example.net/en/", 4: "net/", 5: "example.com/de/", 6: None, 7: "org/fr/", 8: None, 9: "net/", 10: None, 11: None, 12: None}
    assert {k: by[k].rule for k in rules} == rules
    assert [(by[k].host, by[k].path) for k in (3, 11, 12, 13, 14, 15, 16, 21)] == [("www.example.net", "/en/"), ("", ""), ("", ""), ("host.org", ""), ("h.org", "/a"), ("", ""), ("h.org", ""), ("Énet.org", "/Ünet/")]
    verdicts = {1: "block", 2: "allow", 5: "block", 7: "allow", 11: "allow", None: "block", 18: "block", 19: "block", 20: "allow"}
    assert {k: by[k].verdict for k in verdicts} == verdicts
    assert by[18].words[1] == "pills"
    assert url_filter.url_filter(table.limit(0)).count() == 0


def test_host_names_do_not_teach_themselves(spark):
    """Names that run words together are split whatever the table holds beside them."""
    rows = [(1, "http://bestcasinobonus.example.org/en/1"), (2, "http://adultx.example.org/en/2"), (3, "http://citylibrary.example.org/en/3")]
    many = [(10 + k, f"http://host{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}.example.org/en/p{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q") for k in range(3000)]
    for more in ([], many):
        got = url_filter.url_filter(spark.createDataFrame(rows + more, "page_id long, url string"))
        by = {r.page_id: r for r in got.filter("page_id < 10").collect()}
        assert [by[k].words[:n] for k, n in ((1, 3), (2, 2), (3, 2))] == [["best", "casino", "bonus"], ["adult", "x"], ["city", "library"]]
        assert [by[k].verdict for k in (1, 2, 3)] == ["block", "block", "allow"]


def test_rules_equal_sql(spark):
    """Host, path and rule of every page of the smallest tables, by DuckDB."""
    import duckdb

    fits = [(f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')", r) for r, _ in sorted(url_filter.RULES, key=lambda x: -len(x[0]))]
    want = duckdb.sql(f"""
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '/root/testdata/sf0.01/pages.parquet'),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM p),
        q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h)
        SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r in fits)} END FROM q""").fetchall()
    got = url_filter.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule").collect())) == sorted(want)


def plain_verdicts(urls, words):
    """The method without Spark: counts, best of all splits by recursion, two steps of naive Bayes."""
    import functools
    import math
    import re
    from collections import Counter

    split_url = [(u.partition("://")[2], "://" in u) for u in urls]
    hosts = [re.match("[^/?#]*", r).group().lower() for r, _ in split_url]
    paths = [re.match("[^?#]*", r[len(h) :]).group().lower() for (r, _), h in zip(split_url, hosts, strict=True)]
    runs = [re.findall("[a-z]+", h + " " + p) for h, p in zip(hosts, paths, strict=True)]
    counts = Counter(w for p in paths for w in re.findall("[a-z]+", p) if 2 <= len(w) <= url_filter.LONGEST_WORD)
    dictionary, least = {*words}, max(20.0, url_filter.DICTIONARY_SHARE * sum(counts.values()))
    total = sum(counts.values()) + least * len(dictionary)
    usable = {w: n + least * (w in dictionary) for w, n in (Counter({w: 0 for w in dictionary}) | counts | Counter({w: 0 for w in dictionary})).items() if w in dictionary or not url_filter._composed(w, dictionary)}
    usable |= {w: least for w in dictionary if w not in usable}
    log = lambda w: math.log10(usable[w] / total) if w in usable and len(w) > 1 else 1 - math.log10(total) - len(w)

    @functools.cache
    def best(run):
        if not run:
            return 0.0, ()
        return max(((best(run[:k])[0] + log(run[k:]), (*best(run[:k])[1], run[k:])) for k in range(max(0, len(run) - url_filter.LONGEST_WORD), len(run))), key=lambda x: (x[0], len(x[1][-1])))

    tokens = [[w for r in rs for w in best(r)[1]] for rs in runs]

    def odds(bad, good):
        every = {*bad, *good}
        return {w: math.log((bad[w] + 1) / (sum(bad.values()) + len(every))) - math.log((good[w] + 1) / (sum(good.values()) + len(every))) for w in every}

    bad, good = Counter({w: b for w, (b, _) in words.items()}), Counter({w: g for w, (_, g) in words.items()})
    first, sites = odds(bad, good), defaultdict(set)
    for h, ws in zip(hosts, tokens, strict=True):
        sites[h] |= {*ws}
    bad, good = Counter(), Counter()
    for ws in sites.values():
        (bad if sum(first.get(w, 0) for w in ws) >= url_filter.SURE else good).update(ws)
    n_bad, n_good, mu = sum(bad.values()), sum(good.values()), url_filter.BACKGROUND
    final = defaultdict(float, first)
    for w in {*bad, *good}:
        usual = mu * (bad[w] + good[w]) / (n_bad + n_good)
        final[w] += max(-url_filter.SURE, min(url_filter.SURE, math.log((bad[w] + usual) / (n_bad + mu)) - math.log((good[w] + usual) / (n_good + mu))))
    return [(ws, sum(final[w] for w in ws) + math.log(url_filter.PRIOR / (1 - url_filter.PRIOR))) for ws in tokens]


def test_verdicts_against_plain_python(spark):
    rng = np.random.default_rng(9)
    pool = ["casino", "win", "pills", "news", "city", "th", "tion", "er", "library", "bonus", "x", "garden", "cheap"]
    urls = [f"http://{rng.choice(['www.', 'm.', ''])}{''.join(rng.choice(pool, rng.integers(1, 4)))}.example.org/{rng.choice(['en', 'ther', 'newscity', 'a'])}/{k}" for k in range(150)]
    words = {w: (10 * (w in url_filter.BLOCK_WORDS), 10 * (w in url_filter.ALLOW_WORDS)) for w in {*url_filter.BLOCK_WORDS, *url_filter.ALLOW_WORDS}}
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=()).collect()}
    for k, (tokens, score) in enumerate(plain_verdicts(urls, words)):
        assert got[k].words == tokens and abs(got[k].log_odds - score) < 1e-6 and got[k].verdict == ("block" if score > 0 else "allow")


def test_verdicts_of_unseen_names(spark):
    """Names made of two or three dictionary words that no list holds together; words beside them are learnt."""
    rng = np.random.default_rng(10)
    kinds = {"block": url_filter.BLOCK_WORDS, "allow": url_filter.ALLOW_WORDS}
    rows, want = [], {}
    for k in range(400):
        kind = "block" if k % 4 == 0 else "allow"
        name = "".join(rng.choice([w for w in kinds[kind] if len(w) > 2], rng.integers(2, 4), replace=False)) + ("zuvo" if kind == "block" and k % 3 else "")
        rows.append((k, f"http://www.{name}.example.org/en/{k}"))
        want[k] = kind
    rows += [(1000, "http://www.zuvo.example.org/"), (1001, "http://www.example.org/en/")]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()}
    assert np.mean([got[k] == want[k] for k in want]) >= 0.98
    assert (got[1000], got[1001]) == ("block", "allow")


def test_segmentation_against_every_split():
    import itertools

    table = url_filter.Words.of({"ab": 5, "abc": 3, "c": 2, "bc": 7, "a": 1, "d": 4, "cd": 6})
    for run in map("".join, itertools.product("abcd", repeat=5)):
        splits = [[run[a:b] for a, b in zip((0, *cut), (*cut, 5), strict=True)] for n in range(5) for cut in itertools.combinations(range(1, 5), n)]
        best = max(sum(map(table.log, s)) for s in splits)
        assert abs(sum(map(table.log, table.split(run))) - best) < 1e-9


def test_pipeline_against_plain_steps(spark, tmp_path):
    """Each stage on its own input against brute force; the packing against the text that reached it."""
    import corpus_pipeline

    from .test_text_operators import plain_components, plain_dedup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    kept = lambda k: {i for i, *_ in inputs[k]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert kept(1) < kept(0) and sum(i in kept(1) for i in good) >= 0.97 * len(good) and not {i for i, q in labels.items() if q == 0} & kept(1)
    assert kept(2) <= kept(1) and len(kept(2)) >= 0.9 * len(kept(1))
    groups = {i: c for i, _, c in plain_components(inputs[2])}
    assert {key(i) for i in kept(3)} == {i for i, c in groups.items() if i == c}
    assert sorted((key(i), t) for i, t, *_ in inputs[4]) == sorted((i, t) for i, n, m, t in plain_dedup(inputs[3], 50) if n > m)
    check_packing(docs.collect(), inputs[4], 2048, library(BYTES))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_without_ids_and_with_repeated_ones(spark):
    """Each row goes by its own verdict, whatever its id."""
    import corpus_pipeline

    from .edges import prose

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    good = [prose(60) for _ in range(12)]
    junk = "#$% " * 40
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(good)]
    rows += [(None, good[3], "en", "a", 1), (None, prose(60), "en", "a", 2), (None, junk, "en", "a", 3), (5, junk, "en", "a", 4), (5, good[5] + " end", "en", "a", 5), (20, good[5], "en", "b", 6), (0, good[0], "en", "a", len(good[0]))]
    docs = spark.createDataFrame(rows, kind)
    by_rules = corpus_pipeline.quality_rules(spark, docs, "")
    assert by_rules.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(repr, map(tuple, by_rules.collect()))) == sorted(map(repr, [r for r in rows if r[1] != junk]))
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "").collect()
    assert sorted((key(r.doc_id), r.n_chars) for r in kept if r.text != junk and r.doc_id != 5) == sorted([(key(k), len(t)) for k, t in enumerate(good) if k != 5] + [(key(None), 2)])
    assert len([r for r in kept if r.doc_id == 5 and r.text != junk]) == 1 and len([r for r in kept if r.text == junk]) == 1
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_digests(spark, tmp_path):
    frame(spark, awkward(), clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    for r in byte_bpe.op2_byte_bpe(spark, str(tmp_path)).filter("doc_id = 3").collect():
        assert r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pa.__version__
