"""Operators against brute-force versions on small odd documents."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossier.llm import (
    context_tree,
    decontaminate,
    language_id,
    license_scan,
    ngram_join,
    ordinal_quality,
    quality_rules,
    source_mix,
    suffix_dedup,
    token_count,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = repr


def words(text):
    return WORD.findall(text or "")


def five(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=KEY)


# 1 ---------------------------------------------------------------------------------------------------------------


def base_measures(text):
    text, w = text or "", words(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(inside), failed


def test_quality_measures(docs, rows_in, no_docs):
    judged = quality_rules.judge(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert told(judged, *names) == sorted(((r[0], *base_measures(r[1])) for r in rows_in), key=KEY)
    assert judged.filter("kept and base_failed").isEmpty()
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert told(kept, "doc_id") == told(judged.filter("kept"), "doc_id")
    assert quality_rules.judge(no_docs).collect() == [] and quality_rules.kept_documents(no_docs).collect() == []


def test_rules_separate_planted_junk(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 120) + ".") for i in range(60)]
    rows += [(100 + i, " ".join(w + "$$$" for w in prose(i, 120).split())) for i in range(12)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(i, 120).split())) for i in range(12)]
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0] for r in judged.filter("kept").select("doc_id").collect()} == set(range(60))


def test_estimation_follows_the_formulas():
    """Rounds over patterns against a plain loop over documents."""
    votes = [(1, 1, 1)] * 30 + [(-1, -1, 1)] * 8 + [(-1, 1, 0)] * 3 + [(1, -1, -1)] * 2
    counts = collections.Counter(votes)
    got = quality_rules.estimate([(*k, n) for k, n in counts.items()], 3, rounds=4)
    assert quality_rules.estimate([], 1) == (0.8, [0.95], [0.4])
    prior, good, bad = 0.8, [0.95] * 3, [0.4] * 3
    for _ in range(4):
        ps = []
        for v in votes:
            odds = prior / (1 - prior)
            for x, g, b in zip(v, good, bad, strict=True):
                odds *= g / (1 - b) if x == 1 else (1 - g) / b if x == -1 else 1
            ps.append(odds / (1 + odds))
        prior = min(max(sum(ps) / len(ps), 0.01), 0.99)
        for j in range(3):
            told_good = sum(p for p, v in zip(ps, votes, strict=True) if v[j])
            told_bad = sum(1 - p for p, v in zip(ps, votes, strict=True) if v[j])
            b = sum(1 - p for p, v in zip(ps, votes, strict=True) if v[j] == -1) / told_bad
            g = sum(p for p, v in zip(ps, votes, strict=True) if v[j] == 1) / told_good
            bad[j] = min(max(b, 0.05), 0.99)
            good[j] = min(max(g, 0.6, 1 - bad[j] / 2), 0.999)
    assert got[0] == pytest.approx(prior) and got[1] == pytest.approx(good) and got[2] == pytest.approx(bad)


# 2 ---------------------------------------------------------------------------------------------------------------


def linked_groups(rows_in):
    sets = [five(r[1]) for r in rows_in]
    links, parent = collections.Counter(), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[root(i)].append(i)
    least = {}
    for members in groups.values():
        ids = [rows_in[i][0] for i in members if rows_in[i][0] is not None]
        for i in members:
            least[i] = min(ids) if ids else None
    return links, least, groups, sets


@pytest.mark.parametrize("options", [{}, {"node_limit": 3, "block_rows": 4, "block_shingles": 500}])
def test_similar_documents(docs, rows_in, options):
    links, least, _, _ = linked_groups(rows_in)
    got = told(ngram_join.similar_documents(docs, **options), "doc_id", "class_id", "n_links")
    assert got == sorted(((r[0], least[i], links[i]) for i, r in enumerate(rows_in)), key=KEY)


def test_one_per_class(docs, rows_in, no_docs):
    _, _, groups, sets = linked_groups(rows_in)
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    texts = collections.Counter(r[0] for r in kept.select("text").collect())
    for members in groups.values():
        if sets[members[0]]:
            assert sum(texts[t] for t in {rows_in[i][1] for i in members}) == 1
    assert kept.filter("text is null").count() == 3
    assert ngram_join.similar_documents(no_docs).count() == 0 and ngram_join.one_per_class(no_docs).count() == 0


def test_matched_depth():
    assert ngram_join.matched_depth(24, 0.8, 0.9999, 8) == 5
    with pytest.raises(ValueError):
        ngram_join.matched_depth(1, 0.8, 0.9999, 8)


# 3 ---------------------------------------------------------------------------------------------------------------


def repeated(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(spans)
    return out


@pytest.mark.parametrize("max_units", [2000, 1])
def test_removal_report(docs, rows_in, max_units):
    texts = [(r[1] or "").encode() for r in rows_in]
    want = []
    for row, data, spans in zip(rows_in, texts, repeated(texts, 400), strict=True):
        rest = b"".join(data[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(data)], strict=True))
        want.append((row[0], len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest()))
    report = suffix_dedup.removal_report(docs, max_units=max_units)
    assert told(report, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=KEY)


def test_without_repeats(docs, rows_in, no_docs):
    cut = suffix_dedup.without_repeats(docs)
    assert cut.schema == docs.schema
    texts = [(r[1] or "").encode() for r in rows_in]
    want = []
    for row, data, spans in zip(rows_in, texts, repeated(texts, 400), strict=True):
        if spans:
            ends = [0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(data)]
            data = b"".join(data[a:b] for a, b in zip(*ends, strict=True))
            want.append((row[0], data.decode("utf-8", "ignore")))
        else:
            want.append((row[0], row[1]))
    assert told(cut, "doc_id", "text") == sorted(want, key=KEY)
    assert suffix_dedup.removal_report(no_docs).count() == 0 and suffix_dedup.without_repeats(no_docs).count() == 0


def test_pieces_do_not_change_units(monkeypatch):
    from tests.llm.conftest import prose

    texts = [prose(1, 900).encode(), b"y" * 1500, prose(2, 700).encode()]
    whole = suffix_dedup.units(texts, 400)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    parts = suffix_dedup.units(texts, 400)
    assert all((whole[k] == parts[k]).all() for k in whole)


def test_maximal_repeats_list_every_occurrence():
    lefts, rights = [b"cba", b"cbx", b"zzz"], [b"gram-one-x", b"gram-one-y", b"gram-one-x"]
    found = {(a, b, tuple(sorted(g))) for a, b, g in suffix_dedup.maximal_repeats(lefts, rights, 9)}
    assert found == {(2, 9, (0, 1)), (0, 10, (0, 2)), (0, 9, (0, 1, 2))}


# 4 ---------------------------------------------------------------------------------------------------------------


def test_grades_on_held_out_rows(spark):
    from tests.llm.conftest import prose

    rows, ratings = [], []
    for i in range(600):
        grade = i % 3
        text = prose(i, 60)
        if grade == 1:
            text = text.replace(" ", " awful ", 4)
        if grade == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        ratings.append((i, grade))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    rated = spark.createDataFrame([r for r in ratings if r[0] % 5], "doc_id long, grade int")
    rated = rated.union(spark.createDataFrame([(None, 1), (3, None), (10_000, 2)], "doc_id long, grade int"))
    model = ordinal_quality.fit(table, rated)
    assert list(model.limits) == sorted(model.limits)
    got = ordinal_quality.grade_documents(table, model).filter("doc_id % 5 = 0").collect()
    assert sum(round(r["expected_grade"]) == r["doc_id"] % 3 for r in got) / len(got) > 0.95
    assert sum(r["kept"] == (r["doc_id"] % 3 == 2) for r in got) / len(got) > 0.95
    small = ordinal_quality.fit(table, rated, max_train=90)
    assert small.weights.any()


def test_grades_of_odd_rows(docs, rows_in, no_docs, spark):
    ratings = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    got = ordinal_quality.grade_documents(docs, ordinal_quality.fit(docs, ratings))
    assert told(got, "doc_id") == sorted(((r[0],) for r in rows_in), key=KEY)
    assert got.filter("not (tail between 0 and 1)").isEmpty()
    none = ordinal_quality.fit(docs, ratings.filter("false"))
    assert {tuple(r) for r in ordinal_quality.grade_documents(docs, none).select("expected_grade", "tail").collect()} == {(0.0, 1.0)}
    assert ordinal_quality.grade_documents(no_docs, none).count() == 0


def test_gradient_is_that_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(20), 5)
    slots, values, grade = rng.integers(0, 50, 100), rng.random(100), rng.integers(0, 4, 20)
    p = np.concatenate((np.zeros(1 << ordinal_quality.BITS), [-1.0, 0.1, -0.3]))
    p[:50] = rng.normal(size=50)
    data = (slots, values, row, grade, 4, 0.01)
    _, g = ordinal_quality.loss_and_gradient(p, *data)
    for i in (3, 17, len(p) - 3, len(p) - 2, len(p) - 1):
        step = np.zeros(len(p))
        step[i] = 1e-6
        up, down = (ordinal_quality.loss_and_gradient(p + s * step, *data)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


# 5 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, no_docs, monkeypatch):
    from tests.llm.conftest import prose

    notices = list(license_scan.NOTICES.items())
    rows = [(i, f"{prose(i, 40 + i)} {text} {prose(50 + i, 300)}") for i, (_, text) in enumerate(notices)]
    rows += [(100, prose(1, 300)), (101, None), (102, ""), (None, "released UNDER the mit license"), (103, "--- ***")]
    rows += [(104, "released under the mit"), (105, rows[0][1]), (105, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def runs(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    want = []
    for i, text in rows:
        for name, notice in notices:
            n, k = len(runs(notice)), len(runs(notice) & runs(text or ""))
            if 5 * k >= 4 * n:
                want.append((i, name, n, k, k / n))
    got = told(license_scan.scan(table), "doc_id", "license_id", "n_shingles", "n_shared", "containment")
    assert got == sorted(want, key=KEY)
    monkeypatch.setattr(license_scan, "BLOCK", 3)
    assert told(license_scan.scan(table), "doc_id", "license_id", "n_shingles", "n_shared", "containment") == got
    assert license_scan.scan(no_docs).count() == 0
    assert license_scan.scan(table, spark.createDataFrame([(None, None)], "license_id string, text string")).count() == 0


def test_short_and_usual_licenses(spark):
    """Templates of one to four words are found inside longer texts; the usual licences have a template."""
    from tests.llm.conftest import prose

    short = [("one", "copyleft"), ("two", "ISC License"), ("three", "All rights reserved."), ("four", "SPDX-License-Identifier: MIT")]
    rows = [(i, f"{prose(i, 40)}\n{text}\n{prose(9 + i, 90)}") for i, (_, text) in enumerate(short)]
    rows += [(10, "All rights are reserved"), (11, "all RIGHTS reserved"), (12, "reserved"), (13, None), (14, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    templates = spark.createDataFrame(short, "license_id string, text string")
    got = told(license_scan.scan(table, templates), "doc_id", "license_id", "n_shingles", "n_shared")
    assert got == sorted([(0, "one", 1, 1), (1, "two", 1, 1), (2, "three", 1, 1), (3, "four", 1, 1), (11, "three", 1, 1)], key=KEY)
    usual = ["Licensed under the MIT License", "SPDX-License-Identifier: GPL-2.0-only", "the GNU Affero General Public License, version 3"]
    usual = spark.createDataFrame([(i, f"{prose(i, 30)} {x}. {prose(5, 30)}") for i, x in enumerate(usual)], "doc_id long, text string")
    assert told(license_scan.scan(usual), "doc_id", "license_id") == [(0, "MIT-licensed"), (1, "SPDX-GPL-2.0"), (2, "AGPL-3.0")]
    assert told(license_scan.scan(table.filter("doc_id = 2"), license_scan.notices(spark, short=True)), "license_id") == [("All-rights-reserved",)]


# 6 ---------------------------------------------------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def tree_scores(texts, train, depth):
    """Context-tree weighting by dictionaries, node by node."""

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def bits(s, p):
        return [((1 << k) | (s[p] >> (8 - k)), (s[p] >> (7 - k)) & 1) for k in range(8)]

    strings = [b"\0" * depth + lowered(t).encode() + b"\0" for t in texts]
    count, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for s, taught in zip(strings, train, strict=True):
        for p in range(depth, len(s)) if taught else ():
            for u, bit in bits(s, p):
                for d in range(depth + 1):
                    count[s[p - d : p], u][bit] += 1
                    if d < depth:
                        children[s[p - d : p], u].add(s[p - d - 1])
    log_p, stop = {}, {}
    for context, u in sorted(count, key=lambda n: -len(n[0])):
        own = kt(*count[context, u])
        if len(context) == depth:
            log_p[context, u], stop[context, u] = own, 1.0
        else:
            below = sum(log_p[bytes([c]) + context, u] for c in children[context, u])
            top = max(own, below)
            log_p[context, u] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            stop[context, u] = math.exp(math.log(0.5) + own - log_p[context, u])
    out = []
    for s in strings:
        total = 0.0
        for p in range(depth, len(s)):
            for u, bit in bits(s, p):
                q = None
                for d in range(depth, -1, -1):
                    node = (s[p - d : p], u)
                    if node in count:
                        estimate = (count[node][bit] + 0.5) / (sum(count[node]) + 1)
                        q = estimate if q is None else stop[node] * estimate + (1 - stop[node]) * q
                total += math.log10(0.5 if q is None else q)
        out.append(total)
    return out


@pytest.mark.parametrize("chunk_bytes", [24 << 20, 9000])
def test_tree_scores(docs, rows_in, chunk_bytes):
    some = docs.filter("n_chars is null or n_chars < 4000")
    rows = [r for r in rows_in if r[1] is None or len(r[1]) < 4000]
    train = [not held(r[0], 10) for r in rows]
    assert 0 < sum(train) < len(rows)
    count = collections.Counter(w for r, t in zip(rows, train, strict=True) if t for w in words(lowered(r[1])))
    ends = sum(train)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    want = []
    for r, t, score in zip(rows, train, tree_scores([r[1] for r in rows], train, 3), strict=True):
        own = words(lowered(r[1]))
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(count[w] for w in own), ends])
        want.append((r[0], not t, len(own) + 1, sum(count[w] > 0 for w in own) + 1, total, base, score))
    got = told(
        context_tree.score_texts(some, context_tree.held_out(), depth=3, chunk_bytes=chunk_bytes),
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
    want = sorted(want, key=lambda r: (repr(r[:5]), r[5]))
    got = sorted(got, key=lambda r: (repr(r[:5]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-5)


def test_tree_scores_without_training(docs, no_docs):
    got = context_tree.score_texts(docs.filter("doc_id = 65"), F.lit(True)).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (5, 0, 0)
    assert got["score"] == pytest.approx(-8 * (len("one two three four") + 1) * math.log10(2))
    assert context_tree.score_texts(no_docs, context_tree.held_out()).count() == 0


def test_grams_travel_short_and_answers_without_them():
    """Lists of grams were 4.6 bytes a key and went both ways; 5 bytes of context share a bucket now."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(4000)) for _ in range(6)]
    frame = pd.DataFrame({"chunk": [0, 0, 0, 1, 1, 1], "text": texts, "held_out": False})
    asked = pd.concat(context_tree.asked(6, 8, 4)(iter([frame])))
    lists = asked[asked["counts"].isna()]
    keys = [np.cumsum(context_tree.unpacked(k)) for k in lists["keys"]]
    shared = {}
    for bucket, own in zip(lists["bucket"], keys, strict=True):
        for context in set((own >> context_tree.ENDING).tolist()):
            assert shared.setdefault(context, bucket) == bucket
    short = sum(len(zlib.compress(k, 1)) for k in lists["keys"])
    assert short < 3.5 * sum(map(len, keys))
    bucket = lists["bucket"].iloc[0]
    known = np.unique(np.concatenate([k for b, k in zip(lists["bucket"], keys, strict=True) if b == bucket]))
    values = pd.DataFrame({"bucket": bucket, "key": known, "value": np.arange(len(known), dtype=np.float32)})
    got = context_tree.answered(lists[lists["bucket"] == bucket], values)
    assert list(got.columns) == ["chunk", "bucket", "told", "n", "new"]
    for own, told in zip((k for b, k in zip(lists["bucket"], keys, strict=True) if b == bucket), got["told"], strict=True):
        assert len(told) == 4 * len(own)
        assert context_tree.unpacked(told, "<f4").tolist() == np.searchsorted(known, own).tolist()


def test_word_lists_are_totalled_once():
    lists = [np.array([-5, 3, 9]), np.array([3, 8]), np.array([], np.int64)]
    told, new = context_tree.word_totals(lists, [np.array([1, 0, 0]), np.array([2, 4]), np.array([], np.int64)])
    assert [context_tree.unpacked(t).tolist() for t in told] == [[1, 2, 0], [2, 4], []]
    assert new == [2, 1, 0]


def test_places_of_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    asked = rng.integers(0, len(keys), 9000)
    assert (context_tree.Places(keys).of(keys[asked]) == asked).all()
    assert len(context_tree.Places(keys[:0]).of(keys[:0])) == 0


def test_registered_tree_reads_six_bytes_of_context(spark, tmp_path):
    """The byte after "bcdef" hangs on the sixth byte before it; five bytes of context leave it open."""
    from dossier.llm.queries import ENTRIES

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["abcdef1 ", "zbcdef2 "]) for _ in range(200))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ENTRIES["op6_context_tree"].run(spark, str(tmp_path)).filter("held_out").collect()
    train = [not held(i, 10) for i, _ in rows]
    want = tree_scores([t for _, t in rows], train, 6)
    assert got
    for r in got:
        assert r["n_bytes"] == len(rows[r["doc_id"]][1]) + 1
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-5)
        assert r["bits_per_byte"] == pytest.approx(-want[r["doc_id"]] * math.log2(10) / r["n_bytes"], rel=1e-5)


# 7 ---------------------------------------------------------------------------------------------------------------


def mixed(rows_in, weights=(1, 2, 3), most=3):
    rows = [(r[0], r[3], len(words(r[1])), " ".join(str(x) for x in (r[0], r[1]) if x is not None)) for r in rows_in]
    size = collections.Counter()
    for _, source, n, _ in rows:
        size[source] += n
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(most * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if most * size[s] < level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: float(most * size[s]) if s in full else level * weight[s] for s in names}
    out = []
    for s in names:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(r[3].encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        budget, before = math.floor(target[s] + 0.5), 0
        for doc_id, _, n, _ in own:
            epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
            out.append((doc_id, n, size[s], target[s], epochs * n + min(n, max(0, rest - before))))
            before += n
    return out


@pytest.mark.parametrize("bucket_rows", [5_000, 3])
def test_mix(docs, rows_in, no_docs, bucket_rows):
    got = source_mix.mix_sources(docs, bucket_rows=bucket_rows)
    want = mixed(rows_in)
    assert told(got, "doc_id", "size", "source_size", "target", "taken") == sorted(want, key=KEY)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r["t"] - r["w"]) <= 0.5
    assert got.filter("taken > 3 * size").isEmpty()
    assert source_mix.mix_sources(no_docs).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def test_find_items(spark, docs, rows_in, no_docs):
    items = [(i, " ".join(words(rows_in[i][1])[4 : 20 + 3 * i])) for i in range(0, 40, 3)]
    items += [(100, "one two three four"), (101, None), (102, ""), (None, " ".join(words(rows_in[7][1])[:30])), (3, "nowhere " * 30)]
    changed = words(next(r[1] for r in rows_in if r[0] == 60))[20_000:20_040]
    changed[2] = "other"
    items.append((103, " ".join(changed)))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in rows_in:
        for item_id, text in items:
            n, k = len(five(text)), len(five(text) & five(r[1]))
            if n and 5 * k >= 4 * n:
                want.append((r[0], item_id, n, k, k / n))
    names = ("doc_id", "item_id", "n_shingles", "n_shared", "containment")
    assert len(want) > 20
    assert told(decontaminate.find_items(docs, table), *names) == sorted(want, key=KEY)
    assert told(decontaminate.find_items(docs, table, block_shingles=100), *names) == sorted(want, key=KEY)
    hit = {r[0] for r in want}
    clean = decontaminate.drop_contaminated(docs, table, block_shingles=300)
    assert clean.schema == docs.schema
    found = collections.Counter((r[0], r[1]) for r in rows_in)
    bad = {(r[0], r[1]) for r in rows_in for _, t in items if five(t) and 5 * len(five(t) & five(r[1])) >= 4 * len(five(t))}
    assert collections.Counter(map(tuple, clean.select("doc_id", "text").collect())) == collections.Counter(
        {k: n for k, n in found.items() if k not in bad}
    )
    assert hit and decontaminate.find_items(no_docs, table).count() == 0
    assert decontaminate.find_items(docs, table.filter("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, table.filter("false")).count() == len(rows_in)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    got = language_id.identify(table, table.filter(~language_id.held_out())).join(table.select("doc_id", "lang"), "doc_id")
    right = got.filter(language_id.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_languages_of_odd_rows(docs, rows_in, no_docs):
    got = language_id.identify(docs, docs.filter(~language_id.held_out()))
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(((r[0], r[1] == "und") for r in got.select("doc_id", "lang_pred").collect()), key=KEY) == sorted(
        ((r[0], not letters(r[1])) for r in rows_in), key=KEY
    )
    assert got.filter("lang_pred not in ('en', 'de', 'es', 'und') or not (score between 0 and 1)").isEmpty()
    unlearned = language_id.identify(docs, no_docs)
    assert {r[0] for r in unlearned.select("lang_pred").collect()} == {"und"}
    assert language_id.identify(no_docs, docs).count() == 0


def test_filters_return_all_languages():
    import numpy as np

    langs = [f"l{i:02d}" for i in range(70)]
    code = language_id.grams([b" ab "])[0]
    words64 = np.zeros((2, 1 << language_id.SLOT_BITS), np.uint64)
    for lang in (0, 5, 69):
        for slot in language_id.slots(code):
            words64[lang // 64, slot] |= np.uint64(1) << np.uint64(lang % 64)
    total, share = language_id.Filters(langs, words64).shares([b" ab ", b" zq "])
    assert total.tolist() == [len(code)] * 2
    assert np.flatnonzero(share[0] > 0.9).tolist() == [0, 5, 69] and share[1].max() == 0


# 10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"chunk": 700, "overlap": 40}, {"chunk": 60, "overlap": 7}])
def test_tokens(docs, rows_in, no_docs, options):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    keep = docs.filter("n_chars is null or n_chars < 20000") if options else docs
    rows = [r for r in rows_in if not options or r[1] is None or len(r[1]) < 20_000]
    want = [
        (r[0], len((r[1] or "").encode()), n, n > 512)
        for r in rows
        for n in [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)]
    ]
    assert told(token_count.count_tokens(keep, **options), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=KEY)
    assert token_count.count_tokens(no_docs).count() == 0
