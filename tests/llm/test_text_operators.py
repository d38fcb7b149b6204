"""Quality rules, substring dedup, the Jaccard join and language-model scores against brute force."""

import hashlib
import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import _text, lm_scoring, ngram_jaccard, quality_classifier, quality_rules, substring_dedup
from tideline.llm._spark import components

from .edges import awkward, frame, key, lower, prose, words

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"



def test_words_and_windows_match_plain_python():
    texts = [t for _, t, _, _ in awkward()]
    for limit in (1, 300, 1 << 20):
        seen = []
        for row, data, offsets in _text.chunks(pa.array(texts), limit):
            w = _text.Words(data, offsets)
            for k in range(len(offsets) - 1):
                got = [bytes(data[a:b]).decode() for a, b in zip(w.starts[w.first[k] : w.first[k + 1]], w.ends[w.first[k] : w.first[k + 1]], strict=True)]
                seen.append(got)
        assert seen == [words(t) for t in texts]
    data, offsets = _text.raw_column(pa.array(["a b a b a b", "b a b"]))
    h, inside = _text.Words(data, offsets).windows(3)
    assert h[0] == h[2] and h[1] == h[3] == h[6] and h[0] != h[1] and inside.tolist() == [True] * 4 + [False] * 2 + [True]
    values = np.random.default_rng(0).integers(0, 99, 40).astype(np.uint64)
    for width in (1, 2, 5, 31):
        assert _text.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(41 - width)]


def plain_base(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text)


def test_quality_rules(spark):
    rows = awkward()
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    want = sorted((key(i), *plain_base(t)) for i, t, _, _ in rows)
    assert sorted((key(r.doc_id), *(r[c] for c in quality_rules.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(spark.createDataFrame([], EMPTY)).count() == 0


def test_thresholds_follow_their_group(spark):
    """The same symbol density is normal in one source and an outlier in another."""
    dense = lambda: " ".join(w + "#" * 3 for w in prose(60).split())
    rows = [(k, prose(60), "en", "plain") for k in range(300)] + [(1000 + k, dense(), "en", "code") for k in range(300)] + [(5000, dense(), "en", "plain"), (5001, dense(), "en", "tiny")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert not got[5000] and all(got[k] for k in range(300)) and all(got[1000 + k] for k in range(300))


def test_sketches_merge(spark):
    counts = quality_rules.count_texts(frame(spark, awkward()), "doc_id", "text", "lang", "source")
    parts = quality_rules.sketches(counts.filter("id % 2 = 0")).unionAll(quality_rules.sketches(counts.filter("id % 2 <> 0 or id is null")))
    keys = ["lang", "source", "metric", "bucket"]
    merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, quality_rules.sketches(counts).collect()))


def plain_dedup(rows, width):
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - width + 1):
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    for i, t, _, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        yield key(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize(("window", "gram"), [(50, 20), (3, 2), (1, 1)])
def test_substring_dedup(spark, window, gram):
    rows = awkward()
    got = substring_dedup.substring_dedup(frame(spark, rows), window, gram, carry=("lang",)).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(plain_dedup(rows, window))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert substring_dedup.substring_dedup(spark.createDataFrame([], EMPTY)).count() == 0


def test_substring_dedup_of_random_overlaps(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 60, 400)]
    rows = []
    for k in range(60):
        a, n = rng.integers(0, 300), rng.integers(5, 90)
        text = base[a : a + n] + [f"u{x}" for x in rng.integers(0, 5, rng.integers(0, 12))] + base[(b := rng.integers(0, 350)) : b + 40]
        rows.append((int(rng.integers(0, 40)), " ".join(text), None, None))
    rows = list({r[0]: r for r in rows}.values())
    got = substring_dedup.substring_dedup(frame(spark, rows), 12, 5).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(plain_dedup(rows, 12))


def test_digest_of_kept_words(spark, tmp_path):
    rows = awkward()
    frame(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.op4_substring_dedup(spark, str(tmp_path)).collect()
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain_dedup(rows, 50)]
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def plain_components(rows, similarity=75):
    sets = []
    for i, t, _, _ in rows:
        w = words(lower(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= similarity * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    for k, (i, s) in enumerate(sets):
        yield key(i), len(s), key(None if i is None else min(x for x in least[root(k)] if x is not None) if s else i)


def test_jaccard_components(spark):
    rows = awkward()
    got = ngram_jaccard.jaccard_components(frame(spark, rows)).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted(plain_components(rows))
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("size", [6, 9, 14, 30, 80, 120, 260])
def test_jaccard_near_the_threshold(spark, size):
    """Edited copies on both sides of the threshold, by size class of the signatures; groups beyond HOT_GROUP too."""
    rng = np.random.default_rng(size)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(size)]
        for k in range(60 if g == 0 else 8):
            text = list(base)
            for e in rng.integers(0, size, rng.integers(0, max(2, size // 14))):
                text[e] = f"e{rng.integers(0, 10**6)}"
            rows.append((int(1000 * g + k), " ".join(text[: len(text) - int(rng.integers(0, 2))]), None, None))
    got = ngram_jaccard.jaccard_components(frame(spark, rows, clash=False)).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted(plain_components(rows))


def unlinked(left, right, similarity=0.75):
    """Which of the pairs (left[k], right[k]) of sets of hashes share no signature."""
    keys = []
    for sets in (left, right):
        sizes = np.array([len(x) for x in sets])
        value = np.concatenate([np.sort(x) for x in sets])
        row, sig = ngram_jaccard.signatures(np.repeat(np.arange(len(sets)), sizes), value, sizes, similarity)
        keys.append((_text.mix(sig ^ _text.mix(row.astype(np.uint64) + np.uint64(1))), row))
    met = np.zeros(len(left), dtype=bool)
    met[keys[0][1][np.isin(keys[0][0], keys[1][0])]] = True
    return np.flatnonzero(~met)


def test_similar_sets_share_a_signature():
    """Every pair of sizes from 1 to 60 at 0.75 to 0.8, contained and edited, many draws of each."""
    rng = np.random.default_rng(12)
    left, right = [], []
    for a in range(1, 61):
        for b in range(a, 61):
            for common in range(a + 1):
                if 0.75 <= common / (a + b - common) <= 0.8 or (common == a == b and a < 4):
                    for _ in range(60):
                        h = rng.integers(0, 2**64, a + b - common, dtype=np.uint64)
                        left.append(h[:a])
                        right.append(np.concatenate([h[:common], h[a:]]))
    assert len(left) > 15_000 and not len(unlinked(left, right))


def test_contained_sets_share_a_signature():
    rng = np.random.default_rng(13)
    for _ in range(5):
        pool = rng.integers(0, 2**64, (20_000, 48), dtype=np.uint64)
        large = rng.integers(4, 49, len(pool))
        small = np.array([-(-3 * n // 4) for n in large])
        assert not len(unlinked([h[:n] for h, n in zip(pool, large, strict=True)], [h[:n] for h, n in zip(pool, small, strict=True)]))


def test_repeated_signatures_pass_batch_by_batch():
    rng = np.random.default_rng(14)
    sig = np.sort(rng.integers(0, 40, 300))
    node = rng.integers(0, 6, 300)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    groups = defaultdict(set)
    for s, x in zip(sig.tolist(), node.tolist(), strict=True):
        groups[s].add(x)
    want = [(s, x, min(g)) for s, g in sorted(groups.items()) if len(g) > 1 for x in sorted(g)]
    for step in (1, 2, 7, 300):
        cut = [pa.record_batch([pa.array(sig[k : k + step]), pa.array(node[k : k + step])], ["sig", "node"]) for k in range(0, 300, step)]
        got = [tuple(r.values()) for b in ngram_jaccard._repeated(iter(cut)) for r in b.to_pylist()]
        assert got == want
        whole = [list(map(tuple, np.column_stack(cols).tolist())) for cols in ngram_jaccard._runs(iter(cut))]
        assert [x for run in whole for x in run] == list(zip(sig.tolist(), node.tolist(), strict=True))
        assert all(a[-1][0] != b[0][0] for a, b in zip(whole, whole[1:], strict=False))


@pytest.mark.parametrize("features", [1 << 18, 400])
def test_jaccard_of_crowds(spark, monkeypatch, features):
    """A passage that most documents hold, pairs at the threshold among them, and many near copies of two texts."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_FEATURES", features)
    monkeypatch.setattr(ngram_jaccard, "HOT_GROUP", 5)
    rng = np.random.default_rng(15)
    passage, rows = [f"p{k}" for k in range(60)], []
    for k in range(60):
        own = [f"d{k}x{j}" for j in range(int(rng.integers(8, 40)))]
        rows.append((k, " ".join(passage + own), None, None))
        if k % 3 == 0:
            rows.append((200 + k, " ".join([*passage, *own][: -(-3 * (len(own) + 60) // 4) + 3]), None, None))
    for g in range(2):
        text = [f"g{j}" for j in range(25)] + [f"g{g}y{j}" for j in range(20)]
        for k in range(30):
            edited = list(text)
            edited[int(rng.integers(0, 45))] = f"e{g}z{k}"
            rows.append((500 + 100 * g + k, " ".join(edited), None, None))
    got = ngram_jaccard.jaccard_components(frame(spark, rows, clash=False)).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted(plain_components(rows))


def test_jaccard_beside_many_copies(spark):
    """Supersets and a subset at 0.75 to 0.76 of one near copy among many, so that what they share is shared by all copies."""
    base = [f"w{k}" for k in range(303)]
    rows = [(k, " ".join([*base, f"own{k}"]), None, None) for k in range(120)]
    rows += [(1000 + k, " ".join([*base, f"own{k}", *(f"s{k}x{j}" for j in range(98))]), None, None) for k in range(40, 60)]
    rows += [(2000, " ".join([*base, "own70"][-230:]), None, None)]
    got = ngram_jaccard.jaccard_components(frame(spark, rows, clash=False)).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted(plain_components(rows))
    assert {r.component_id for r in got} == {0}


def test_components_of_paths_stars_and_nothing(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(300, 300), (500, None)] + [(int(a), int(b)) for a, b in rng.integers(600, 700, (60, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in edges:
        if b is not None and a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_scores(spark):
    rows = [(k, prose(80), None, None) for k in range(120)] + awkward()
    got = lm_scoring.lm_scores(frame(spark, rows)).collect()
    held = lambda i: i is not None and crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*words(lower(t)), ""]) for i, t, _, _ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n = sum(c.values())
    norm = n + 0.1 * (len(c) + 1)
    want = sorted((key(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / norm) for w in ws), 6)) for i, ws in tokens)
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.lm_scores(spark.createDataFrame([], EMPTY)).count() == 0


def lexicon_of(n, classes):
    return lm_scoring.Lexicon.of(np.arange(n, dtype=np.uint64), np.random.default_rng(1).random(n + 3) + 0.1, classes)


def test_lm_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(2)
    lexicon = lexicon_of(10, 4)
    model = lm_scoring.LogBilinear(lexicon)
    ids = np.zeros(40_000, np.int32)
    for k in range(1, len(ids)):
        ids[k] = (ids[k - 1] + 1) % 10 if rng.random() < 0.8 else rng.integers(0, 10)
    tokens = lm_scoring.Tokens.run(ids, np.array([len(ids)]), lexicon.start)
    at_first = model.log_probs(tokens).mean()
    trainer = lm_scoring.Trainer(model, 1)
    for _ in range(20):
        trainer.learn(tokens)
    assert model.log_probs(tokens).mean() > at_first + 0.6
    every = lm_scoring.Tokens(np.arange(13, dtype=np.int32), np.zeros(13, np.int64), np.tile([[3], [4]], 13).astype(np.int32))
    assert abs(np.exp(model.log_probs(every)).sum() - 1) < 1e-5


def test_mean_model_weighs_rows_by_what_was_met():
    model = lm_scoring.LogBilinear(lexicon_of(5, 2))
    rng = np.random.default_rng(3)
    models = [([p + rng.standard_normal(p.shape) for p in model.parts()], [rng.integers(0, 3, len(model.context)).astype(float), rng.integers(0, 3, len(model.target)).astype(float)], float(k + 1)) for k in range(4)]
    mean, met, tokens = lm_scoring.mean_model(models)
    assert tokens == 10 and all(np.allclose(m, sum(x[1][k] for x in models)) for k, m in enumerate(met))
    for row in range(len(model.target)):
        weights = [x[1][1][row] for x in models]
        want = models[0][0][2][row] if not sum(weights) else np.average([x[0][2][row] for x in models], axis=0, weights=weights)
        assert np.allclose(mean[2][row], want)
    assert np.allclose(mean[1], np.average([x[0][1] for x in models], axis=0, weights=[1, 2, 3, 4]))


def plain_score(text, trained, counts):
    """log10 probability of a text by the definition: one product at a time, every class and token summed."""
    m, lexicon = trained.model, trained.lexicon
    data, offsets = _text.raw_column(pa.array([lower(text)]))
    w = _text.Words(data, offsets)
    ends = [*w.hash.tolist(), None]
    numbers, total = [], 0.0
    for h, bucket in zip(ends, [*lm_scoring.buckets(w).tolist(), None], strict=True):
        known = None if h is None else int(lexicon.known(np.array([h], np.uint64))[0])
        number = lexicon.end if h is None else known if known >= 0 else len(lexicon.hashes) + bucket
        context = [numbers[-k] if len(numbers) >= k else lexicon.start for k in (1, 2)]
        predicted = sum(np.array([sum(float(m.context[c][i]) * float(m.place[k][i][j]) for i in range(lm_scoring.WIDTH)) for j in range(lm_scoring.WIDTH)]) for k, c in enumerate(context))
        logit = lambda v, b: float(np.dot(predicted, v.astype(float))) + float(b)
        klass = int(lexicon.klass[number])
        kinds = [logit(v, b) for v, b in zip(m.kind, m.kind_bias, strict=True)]
        inside = [logit(m.target[t], m.bias[t]) for t in np.flatnonzero(lexicon.klass == klass)]
        total += kinds[klass] - math.log(sum(map(math.exp, kinds))) + logit(m.target[number], m.bias[number]) - math.log(sum(map(math.exp, inside)))
        if known == -1:
            mass = 0.1 + sum(n + 0.1 for x, (n, b) in counts.items() if b == bucket and lexicon.known(np.array([x], np.uint64))[0] < 0)
            total += math.log((counts.get(h, (0, 0))[0] + 0.1) / mass)
        numbers.append(number)
    return total / math.log(10)


def test_score_against_plain_python_and_other_partitions(spark, monkeypatch):
    for name, value in (("VOCABULARY", 40), ("FREQUENT", 90), ("GROUP_TOKENS", 3000), ("FAN_IN", 2), ("CLASSES", 5)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}{'abc'[int(x) % 3]}" for x in rng.zipf(1.3, 150) % 400) for _ in range(80)] + ["", None, "unseen W1b w2c"]
    rows = spark.createDataFrame([(k, False, t) for k, t in enumerate(texts)], "id long, held boolean, text string")
    found = []
    for parts in (1, 8):
        table = rows.repartition(parts)
        trained = lm_scoring.learn(table.filter("id < 70").select("id", "text"))
        found.append({r.id: r.score for r in lm_scoring.score_texts(table, trained).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-4 for k in found[0])
    counts = {np.uint64(r.h & (2**64 - 1)): (r.n, r.bucket) for r in trained.counts.collect()}
    for k in (0, 75, 80, 81, 82):
        assert abs(plain_score(texts[k] or "", trained, counts) - found[1][k]) < 1e-3


def test_classifier(spark):
    good = [(k, prose(60), None, None) for k in range(200)]
    bad = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(60).split()), None, None) for k in range(60)]
    docs = frame(spark, good + bad + awkward())
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == 260 + len(awkward()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    wrong = [r for r in got if r.doc_id is not None and (20 <= r.doc_id < 200 and not r.predicted or r.doc_id >= 1000 and r.predicted)]
    assert not wrong
    none = quality_classifier.quality_classifier(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert [round(r.score, 6) for r in none] == [0.7]
    assert quality_classifier.quality_classifier(spark.createDataFrame([], EMPTY), labels).count() == 0


def labelled(spark, n, share):
    """n rows of features, of which good ones lie higher, as tables of rows and labels; taught ones as arrays."""
    rng = np.random.default_rng(n)
    good = rng.random(n) < share
    x = rng.standard_normal((n, len(quality_classifier.FEATURES))) * 3 + 0.4 * good[:, None] + 100
    rows = spark.createDataFrame(pa.table({"id": pa.array(range(n)), "x": pa.array(list(x), pa.list_(pa.float64()))}))
    taught = np.array([crc32(str(k).encode()) % 4 != 2 for k in range(n)])
    return rows, spark.createDataFrame(pa.table({"doc_id": pa.array(range(n)), "quality": pa.array(good.astype(int))})), x[taught], good[taught]


def test_classifier_learns_from_all_pairs(spark):
    rows, labels, x, good = labelled(spark, 900, 0.6)
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / scale, -8, 8)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ p / len(d) - 1e-3 * w)
    for parts in (1, 5):
        got = quality_classifier.train(rows.repartition(parts), labels).weights * scale
        assert np.abs(got - w).max() < 1e-3 * np.abs(w).max()


def test_classifier_threshold_is_of_all_labelled_rows(spark):
    rows, labels, x, good = labelled(spark, 40_000, 0.5)
    model = quality_classifier.train(rows, labels)
    s = np.sort(x @ model.weights)
    k = int((~good).sum())
    assert s[k - 1] + 1e-9 < -model.bias < s[k] - 1e-9 and abs(model.bias + (s[k - 1] + s[k]) / 2) < 1e-9


def test_order_statistics_by_counting(spark):
    for values in ([5.0], [2.0] * 7, [-1e300, -3.0, 0.0, 5e-324, 1e-9, 1e-9, 1e-9, 7.0, 1e300], [float(x) for x in np.random.default_rng(0).zipf(1.4, 500)]):
        table, ordered = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
        for k in {1, len(values) // 2, len(values) - 1} - {0, len(values)}:
            assert quality_classifier.kth_and_next(table, k) == (ordered[k - 1], ordered[k])


def test_hashes_are_found_by_their_leading_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100, 3000):
        for hashes in (np.arange(n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)):
            hashes = np.unique(np.append(hashes, np.array([0, 2**64 - 1], np.uint64)[:n]))
            keys = np.concatenate([hashes, rng.integers(0, 2**64, 200, dtype=np.uint64), np.arange(200, dtype=np.uint64), np.array([2**64 - 1], np.uint64)])
            place = {int(h): k for k, h in enumerate(hashes)}
            assert lm_scoring.Sorted(hashes).find(keys).tolist() == [place.get(int(k), -1) for k in keys]


@pytest.mark.parametrize("size", [1, 40])
def test_log_probs_of_small_and_large_products(size):
    model = lm_scoring.LogBilinear(lexicon_of(50, 6))
    model.target *= size * 10
    model.kind *= size * 10
    ids = np.random.default_rng(2).integers(0, 53, 300).astype(np.int32)
    tokens = lm_scoring.Tokens.run(ids, np.array([100, 0, 200]), 53)
    h = sum(model.context[tokens.before[k]].astype(float) @ model.place[k] for k in (0, 1))
    plain = lambda x, own: x[np.arange(len(x)), own] - x.max(axis=1) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1))
    want = plain(h @ model.kind.T + model.kind_bias, model.klass[ids])
    inside = np.where(model.klass[None] == model.klass[ids][:, None], h @ model.target.T + model.bias, -np.inf)
    assert np.allclose(model.log_probs(tokens), want + plain(inside, ids), atol=1e-3 * size)
