from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import ODD

from clausewright.llm import crf, exact, fingerprint, interpolation, licenses, mixing, near, packing, sampling, store, substring, toxicity
from clausewright.llm import words as W

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def same(rows):
    return sorted(rows, key=repr)


@pytest.fixture(params=["documents", "odd", "twice", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_fingerprints(table):
    rows = fingerprint.fingerprints(table)
    assert got(rows, "doc_id", "n_chars", "edited_sha256") == same(brute.edited(plain(table)))
    every = rows.collect()
    assert all(0 <= x <= 1 for r in every for x in (r.near_edited, r.near_next))


def test_fingerprints_by_a_plain_rule(table):
    rule = (fingerprint._GEAR, fingerprint.LEAST, fingerprint.USUAL, fingerprint.MOST, fingerprint.RARE, fingerprint.COMMON)
    rows = fingerprint.fingerprints(table).selectExpr("doc_id", "fingerprint", "edited_fingerprint", "round(near_edited, 9)", "round(near_next, 9)")
    assert got(rows) == same(brute.fingerprints(plain(table), *rule))


def test_fingerprints_follow_content(spark):
    body = " ".join(f"word{k * k % 7919}" for k in range(2000)).encode()
    a, b = fingerprint.chunks(body), fingerprint.chunks(b"some words before " + body[:5000] + b" an insertion " + body[5000:])
    assert fingerprint.containment(a, b) > 0.95 and fingerprint.containment(a, fingerprint.chunks(body[::-1])) < 0.05
    assert sum(len(body[s:e]) for s, e in zip([0, *fingerprint.ends(body)], fingerprint.ends(body), strict=False)) == len(body)
    assert max(np.diff([0, *fingerprint.ends(body)])) <= fingerprint.MOST
    assert fingerprint.containment({}, {}) == 1 and fingerprint.containment(a, {}) == 0
    half = spark.createDataFrame([(1, body.decode()), (2, body.decode()[::-1])], "doc_id long, text string")
    first = fingerprint.fingerprints(half).where("doc_id = 1").head()
    assert 0.45 < first.near_edited < 0.55 and first.near_next < 0.05


@pytest.mark.parametrize("window", [4, 35, 100])
def test_substrings(table, window):
    rows = substring.remove_repeats(table, window=window)
    assert got(rows, "doc_id", "n_words", "n_removed", "kept_sha256") == same(brute.kept_words(plain(table), window))


def test_levels_double_up_to_the_window():
    for window in range(2, 300):
        levels = [*substring.lengths(window), window]
        assert levels[0] <= substring.SEED and all(2 * a - 1 <= b <= 2 * a for a, b in zip(levels[:-1], levels[1:], strict=True))
    assert substring.lengths(35) == [9, 18] and substring.lengths(100) == [7, 13, 25, 50]


@pytest.mark.parametrize("window", [2, 9, 50])
def test_substrings_planted_at_all_places(spark, window):
    rng = np.random.default_rng(window)
    shared = [[f"s{k}_{j}" for j in range(int(window * f))] for k, f in enumerate((0.9, 1, 1.1, 2, 5))]
    rows = []
    for i in range(60):
        words: list[str] = []
        for _ in range(int(rng.integers(1, 6))):
            words += [f"o{i}_{len(words) + j}" for j in range(int(rng.integers(0, 2 * window)))]
            run = shared[int(rng.integers(len(shared)))]
            words += run[int(rng.integers(0, len(run))) :] if rng.random() < 0.5 else run
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(substring.remove_repeats(df, window=window), "doc_id", "n_words", "n_removed", "kept_sha256") == same(brute.kept_words(rows, window))


def test_substrings_in_one_text_and_at_edges(spark):
    run = [f"a{k}" for k in range(40)]
    texts = [" ".join([*run, "x", *run]), " ".join(run[:34]), " ".join(["y", *run[2:37], "z"]), " ".join(["same"] * 36), " ".join(["other"] * 35)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert got(substring.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == same(brute.kept_words(list(enumerate(texts))))


def test_near_groups(documents, odd, empty, pairs):
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    assert got(near.near_groups(documents), *columns) == same(brute.components(pairs))
    assert got(near.near_groups(odd), *columns) == same(brute.components(ODD))
    assert near.near_groups(empty).count() == 0


def test_near_groups_of_rows_without_or_with_equal_ids(twice):
    rows = near.near_groups(twice).collect()
    assert len(rows) == 2 * len(ODD) + 2
    wanted = {i: (n, c) for i, n, c, _ in brute.components(ODD)}
    assert all((r.n_shingles, r.component_id) == wanted[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def family(n: int, seed: int = 0) -> list[tuple[int, str]]:
    """A large group: copies of one text with more and more words changed, about and below the threshold, and chains."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(150)]
    out, last = [], base
    for k in range(n):
        own = list(last if k % 3 == 0 else base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            own[at] = f"n{k}_{at}"
        last = own
        out.append((k, " ".join(own)))
    return out


@pytest.mark.parametrize(("tile", "weight"), [(8, 1 << 21), (512, 1 << 21), (512, 1000)])
def test_near_groups_lose_no_link_of_a_large_group(spark, monkeypatch, tile, weight):
    monkeypatch.setattr(near, "TILE", tile)
    monkeypatch.setattr(near, "WEIGHT", weight)
    rows = family(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = brute.components(rows)
    assert 1 < len({c for _, _, c, _ in wanted}) < 120
    assert got(near.near_groups(df), "doc_id", "n_shingles", "component_id", "kept") == same(wanted)


def short_families(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts of 1 to 200 words in families of several subfamilies, so that a bucket's members are alike to all degrees."""
    rng = np.random.default_rng(seed)
    out: list[str] = []
    while len(out) < n:
        length, i = int(rng.choice([1, 5, 6, 7, 9, 12, 14, 20, 30, 60, 120, 200])), len(out)
        subs = []
        for s in range(int(rng.integers(3, 7))):
            subs.append([f"f{i}_{k}" for k in range(length)])
            for at in rng.integers(0, length, int(rng.integers(0, max(2, length // 12)))):
                subs[-1][at] = f"s{i}_{s}_{at}"
        for m in range(int(rng.integers(5, 25))):
            own = list(subs[int(rng.integers(len(subs)))])
            for at in rng.integers(0, length, int(rng.integers(0, max(2, length // 25 + 1)))):
                own[at] = f"m{i}_{m}_{at}"
            out.append(" ".join(own[: int(rng.integers(max(1, length - 3), length + 1))] if rng.random() < 0.3 else own))
    rng.shuffle(out)
    return list(enumerate(out))


W14 = [f"w{k}" for k in range(14)]
#: The first of a bucket is loosely related to two texts that are linked to each other.
LOOSE_HUB = [(1, " ".join([*W14[:3], "x", *W14[4:]])), (2, " ".join([*W14[:9], "y", "z", *W14[11:]])), (3, " ".join(W14[:13])), (4, " ".join(W14))]


@pytest.mark.parametrize(("percent", "rows"), [(85, LOOSE_HUB), (80, short_families(1, 800)), (85, short_families(2, 800))], ids=["hub", "families 1", "families 2"])
def test_near_groups_of_short_texts(spark, percent, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near.near_groups(df, percent=percent), "doc_id", "n_shingles", "component_id", "kept") == same(brute.components(rows, percent=percent))


def test_bands_propose_nearly_all_links():
    rows = short_families(3, 1500)
    sets = [near.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 5)[0] for _, t in rows]
    bands = near.signatures(sets).reshape(-1, near.BANDS, near.BAND)
    held = near.common(sets)
    size = np.array([len(x) for x in sets])
    links = [(i, j) for i, j in np.argwhere(np.triu(100 * held >= 80 * (size[:, None] + size - held), 1) & (held > 0))]
    met = [((bands[i] == bands[j]).all(-1) & (bands[i] > 0).any(-1)).any() for i, j in links]
    assert len(links) > 1000 and np.mean(met) > 0.9999


def holders(n: int) -> list[tuple[int, str]]:
    """n long texts that hold one passage, and after them two short ones that are little more than the passage."""
    passage = [f"p{k}" for k in range(100)]
    own = [[*passage, *(f"l{i}_{k}" for k in range(150))] for i in range(n)] + [[*passage, *(f"s{i}_{k}" for k in range(7))] for i in range(2)]
    return [(i, " ".join(w)) for i, w in enumerate(own)]


@pytest.mark.parametrize("block", [64, 1024])
def test_near_copies_meet_though_their_buckets_begin_with_other_texts(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = holders(1500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = {r.doc_id: r.component_id for r in near.near_groups(df).collect()}
    assert component == {i: min(i, 1500) for i, _ in rows}


def test_members_of_a_bucket_meet_as_if_all_were_compared():
    rng = np.random.default_rng(4)
    r = rng.integers(1, 60000, (6, near.REGISTERS)).astype(np.uint16)[rng.integers(0, 6, 150)]
    r = np.where(rng.random(r.shape) < rng.choice([0.02, 0.1, 0.3, 0.5], (150, 1)), rng.integers(1, 60000, r.shape), r).astype(np.uint16)
    top = list(range(150))
    for i, k in near.meeting(np.arange(150), r, 0.5):
        assert near.estimate(r[i], r[k])[0] >= 0.5
        top = [top[i] if x == top[k] else x for x in top]
    links = [(i, k) for i in range(150) for k in range(i) if near.estimate(r[i], r[k])[0] >= 0.7]
    assert links and all(top[i] == top[k] for i, k in links)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        n, both = 1000, int(2000 * share / (1 + share))
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
        guesses = []
        for k in range(20):
            x = near.mix(pool + np.uint64(k))
            s = near.signatures([np.unique(x[:n]), np.unique(np.concatenate([x[:both], x[2000 : 2000 + n - both]]))])
            guesses.append(near.estimate(s[0], s[1])[0])
        assert abs(np.mean(guesses) - share) < 0.03


def test_exact(table):
    groups = defaultdict(list)
    rows = plain(table)
    norm = lambda t: brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    wanted = [(i, least[norm(t)], len(groups[norm(t)]), i == least[norm(t)]) for i, t in rows]
    assert got(exact.copies(table), "doc_id", "keep_id", "group_size", "kept") == same(wanted)
    kept = exact.keep_first(table)
    own = {(norm(t), i) for i, t in rows if i == least[norm(t)]}
    assert kept.columns == table.columns
    assert same((norm(r.text), r.doc_id) for r in kept.collect()) == same(own)


def test_first_copies_are_told_by_id_and_text(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "c"), (None, "c"), (None, "d"), (None, "d"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(exact.keep_first(df), "doc_id", "text") == same([(1, "a"), (2, "b"), (4, "c"), (None, "d"), (5, None)])


def test_stages_keep_all_columns_of_all_tables(spark, table, labels):
    data = table if "source" in table.columns else table.selectExpr("*", "concat('s', doc_id % 7) as source")
    n = data.count()
    for stage in (lambda x: crf.keep_good(x, labels), exact.keep_first, near.keep_one, mixing.take):
        out = stage(data)
        assert out.columns == data.columns
        assert out.count() <= 2 * n and out.exceptAll(data.unionAll(data)).count() == 0
    one = near.keep_one(data)
    near_ids = {i for i, _, _, k in brute.components([(i, t) for i, t in {(i, t) for i, t in plain(data)} if i is not None]) if k}
    assert {r.doc_id for r in one.collect()} - {None} == near_ids and one.where("doc_id is null").count() == data.where("doc_id is null").count()


def test_the_filter_only_passes_what_is_alone(spark, monkeypatch):
    monkeypatch.setattr(exact, "MOST_CELLS", exact.SHARD)
    monkeypatch.setattr(exact, "CELLS_PER_TEXT", 1)
    df = spark.range(200_000).selectExpr("id div 1 as doc_id", "cast(if(id % 50 = 0, id div 100, id) as string) as text")
    rows = exact.copies(df)
    assert rows.count() == 200_000
    assert rows.where("group_size > 1").count() == df.groupBy("text").count().where("count > 1").selectExpr("sum(count)").head()[0]


def labels_of(rows):
    return brute.license_labels(rows, licenses.every_template(), licenses.GRAM, licenses.DRIFT, licenses.VOTED, licenses.ENOUGH, licenses.SHORT, licenses.HALF_WAY)


def test_licenses(table):
    rows = plain(table)
    scan = licenses.scan(table).cache()
    assert got(scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == same(brute.phrases(rows, licenses.PHRASES))
    assert got(scan.selectExpr("doc_id", "labels", "round(score, 9) as score"), "doc_id", "labels", "score") == same((i, x, round(float(n), 9)) for i, x, n in labels_of(rows))
    for r in scan.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_notices_changed_cut_up_repeated_and_named(spark):
    rng = np.random.default_rng(9)
    whole = {label: text for label, text in licenses.NOTICES if len(text.split()) > 20}
    bsd = next(t for label, t in licenses.NOTICES if label == "bsd").split()
    foreign = lambda n: [f"f{int(k)}" for k in rng.integers(0, 10**6, n)]
    pieces_ = [w for k in range(0, len(bsd), 5) for w in [*bsd[k : k + 5], *foreign(6)]]
    texts = [
        "x " * 50 + " ".join([*bsd[:5], "indeed", *bsd[5:12], *bsd[13:]]) + " y", " ".join(bsd[:5]), " ".join(reversed(bsd)), "licensed under CC BY-NC 4", " ".join(pieces_),
        "The MIT License (MIT)", "SPDX-License-Identifier: Apache-2.0", "GNU General Public License version 3", "released under CC-BY-SA 4.0", "the license of a driver, and terms of the bank",
    ]
    for text in whole.values():
        words = text.split()
        texts.append(" ".join([*foreign(20), *words, *foreign(7), *words]))
        for share in (0.03, 0.1, 0.2, 0.4):
            changed: list[str] = []
            for w in words:
                changed += [w] if rng.random() > share else [[], ["new"], [w, "more"]][int(rng.integers(3))]
            texts.append(" ".join([*foreign(5), *changed, *foreign(5)]))
    rows = list(enumerate(texts))
    scanned = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [(i, r.labels, round(r.score, 9)) for i, r in sorted(scanned.items())] == [(i, x, round(float(n), 9)) for i, x, n in labels_of(rows)]
    assert scanned[0].labels == "bsd" and 0.5 <= scanned[0].score < 1 and scanned[0].n_base == 0
    assert [scanned[k].labels for k in range(1, 10)] == ["", "", "cc-by-nc", "", "mit", "apache-2", "gpl", "cc-by-sa", ""]
    assert all(label in scanned[10 + 5 * k + c].labels.split(",") for k, label in enumerate(whole) for c in (0, 1, 2))


def test_short_forms_are_named_stated_or_talked_about(spark):
    """What people write of a license in a few words has its label, and a score below a notice's; a word that looks like one has none."""
    named, stated = licenses.NAMED, licenses.STATED
    wanted = {
        "License: MIT": ("mit", stated), "This project uses MIT.": ("mit", stated), "Apache 2.0 licensed": ("apache-2", stated), "GPLv3": ("gpl", named), "license: GPLv3": ("gpl", stated),
        "SPDX-License-Identifier: BSD-3-Clause": ("bsd", stated), "licensed under CC-BY-SA 4.0": ("cc-by-sa", stated), "we discussed the MIT license debate of 1988": ("mit", named),
        "released under the MIT license": ("mit", stated), "a degree from MIT, with a license to drive": ("", 0), "the apache helicopter, 2 of them": ("", 0), "mit": ("", 0), "": ("", 0),
        dict((k, t) for k, t in licenses.NOTICES if k == "isc")["isc"]: ("isc", None), "License: AGPLv3 or MIT licensed": ("agpl,mit", stated),
    }
    rows = list(enumerate(wanted))
    got_ = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        labels, score = wanted[text]
        assert got_[k][0] == labels, text
        assert got_[k][1] > 0.9 if score is None else got_[k][1] == score, text
    assert [(i, got_[i][0], round(got_[i][1], 9)) for i, _ in rows] == [(i, x, round(float(n), 9)) for i, x, n in labels_of(rows)]


def test_packing(table):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(table, TOKENIZER, capacity=64).collect()
    wanted = Counter()
    for i, t in plain(table):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 64)):
            wanted[i, n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(brute.gapless(v) and sum(n for _, n in v) <= 64 for v in by_sequence.values())
    if rows:
        assert len(by_sequence) <= 1.12 * -(-sum(r.length for r in rows) // 64) + 2


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    coder, own, pick = Tokenizer.from_file(TOKENIZER), packing.Ids(TOKENIZER), random.Random(5)
    odd = [*map(chr, range(1, 127)), *"İıΣσςßéÉſKﬁ中ひאا١Ⅷ😀ǅʹ", "\u0301", "\u0307", "\u0345", "\u200b", "\u00a0", "\u2028", "\x85", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL"]
    every = [chr(k) for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(pick.choice(odd if pick.random() < 0.7 else every) for _ in range(pick.randint(0, 8))) for _ in range(20_000)]
    for text, ids in zip(texts, own.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("lengths", [{1: 1}, {2048: 3}, {1025: 10, 1023: 10}, {700: 7, 683: 5, 2: 3}, {k: k % 7 + 1 for k in range(1, 2048, 13)}])
def test_plans_hold_every_piece(lengths):
    runs = packing.plan(lengths, 2048)
    held = Counter()
    for r in runs:
        assert r.count > 0 and r.free == 2048 - sum(k * n for k, n in r.content.items()) >= 0
        for k, n in r.content.items():
            held[k] += n * r.count
    assert held == Counter(lengths)
    least = max(-(-sum(k * n for k, n in lengths.items()) // 2048), sum(n for k, n in lengths.items() if k > 1024))
    assert sum(r.count for r in runs) <= 1.05 * least + 1


def test_mixing(table):
    rows = mixing.mix(table if "source" in table.columns else table.selectExpr("*", "concat('s', doc_id % 7) as source"))
    data = table if "source" in table.columns else table.selectExpr("*", "concat('s', doc_id % 7) as source")
    sizes: dict = defaultdict(int)
    for r in data.select("source", "text").collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    wanted = brute.targets(sizes)
    source = {r.doc_id: r.source for r in data.select("doc_id", "source").collect()}
    took, largest = defaultdict(int), defaultdict(int)
    every = rows.collect()
    assert len(every) == data.count() and same(map(tuple, every)) == same(map(tuple, mixing.mix(data.repartition(5)).collect()))
    unit = Counter()
    for r in every:
        if r.doc_id is None:
            continue
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
        unit[r.doc_id] += r.size
        largest[s] = max(largest[s], unit[r.doc_id])
    if all(r.doc_id is not None for r in every):
        for s, n in sizes.items():
            assert abs(took[s] - wanted[s]) <= largest[s] / 2 + 1e-6
    taken = mixing.take(data)
    assert taken.columns == data.columns
    assert taken.count() == sum(round(r.taken / r.size) if r.size else 0 for r in every if r.size) + taken.where("text is null or regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') = 0").count()


def test_language_model(table):
    rows = interpolation.scores(table)
    every = {}
    for r in rows.collect():
        every.setdefault((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens), []).append(r)
    wanted = Counter()
    for i, held, n, known, total, score in brute.base_scores(plain(table)):
        wanted[i, n, known, held, total] += 1
        assert any(abs(r.base_score - score) < 1e-6 for r in every[i, n, known, held, total])
    assert wanted == Counter({k: len(v) for k, v in every.items()})
    assert all(r.score < 0 or r.score == pytest.approx(0) for v in every.values() for r in v)


def test_language_model_scores_under_given_weights(table):
    rng = np.random.default_rng(8)
    weights, trust = rng.dirichlet((1, 1, 1), interpolation.BUCKETS), rng.random(interpolation.BUCKETS)
    bucket = lambda n: int(interpolation.bucket_of(np.array([n]))[0])
    wanted = defaultdict(list)
    for i, score in brute.interpolated(plain(table), (weights, trust), bucket):
        wanted[i].append(score)
    scored = defaultdict(list)
    for r in interpolation.scores(table, mixture=(weights, trust)).collect():
        scored[r.doc_id].append(r.score)
    assert {k: len(v) for k, v in wanted.items()} == {k: len(v) for k, v in scored.items()}
    assert all(np.allclose(sorted(v), sorted(scored[k]), rtol=1e-9) for k, v in wanted.items())


def test_counts_beyond_32_bits_stay_whole():
    counts = np.array([0, 254, 255, 3_000_000_000, 1 << 52])
    assert interpolation._large(interpolation._small(counts), 5).tolist() == counts.tolist()
    assert interpolation._added(np.array([0, 1, 0]), np.array([3_000_000_000, 1, 1 << 50]), 2).tolist() == [3_000_000_000 + (1 << 50), 1]
    one, two = interpolation._contexts(counts, counts + 1, np.array([2, 3]), 5_000_000_000)
    assert one.tolist() == [5_000_000_000, 0, 5_000_000_000, 255, 3_000_000_000] and two[4] == 3_000_000_001
    assert (interpolation.bucket_of(counts) >= 0).all() and (interpolation._shares([counts, counts, counts], (one, two), 1 << 53)[0] >= 0).all()


def test_weights_reach_the_likeliest_mixture():
    # three tokens in four follow the triple's estimate: its share of the likelihood is found again
    rng = np.random.default_rng(2)
    sums = [(3, 16, 1 if rng.random() < 0.75 else -1, 1.0) for _ in range(4000)]
    trust = interpolation.learned_trust(sums)
    lower, high = interpolation.value_of(np.array([16, 1]))
    hits = sum(t >= 0 for _, _, t, _ in sums) / len(sums)
    likelihood = lambda t: hits * np.log(t * high + (1 - t) * lower) + (1 - hits) * np.log((1 - t) * lower)
    best = max(np.linspace(0.01, 0.99, 981), key=likelihood)
    assert abs(trust[3] - best) < 0.01 and trust[0] == 0


def test_language_model_is_a_distribution_and_better_than_its_base(documents):
    rows = interpolation.scores(documents).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").head()
    assert rows.s > rows.b
    weights = interpolation.learned_weights([(3, 20, 5, 100.0), (3, 30, -1, 50.0), (0, 10, -1, 5.0)], 1000)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def auc(rows, label):
    score = sorted((r.score, label[r.doc_id]) for r in rows if r.doc_id in label)
    yes, no = [s for s, y in score if y], [s for s, y in score if not y]
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))


def test_quality(spark, data, odd, twice, empty, labels):
    documents = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    known = spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    rows = crf.scores(documents, known).collect()
    label = {r.doc_id: r.quality for r in known.collect()}
    held = [r for r in rows if r.held_out]
    assert auc(held, label) > 0.97
    assert {r.held_out for r in rows if brute.crc(r.doc_id, 4) == 2} == {True}
    assert np.mean([(r.score >= 0.7) == label[r.doc_id] for r in held if r.doc_id in label]) > 0.95
    for table in (odd, twice, empty):
        some = crf.scores(table, known).collect()
        assert len(some) == table.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in some)
    assert crf.keep_good(odd, known).columns == odd.columns
    assert {r.score for r in crf.scores(odd, known.limit(0)).collect()} == {0.5}


def test_quality_scores_equal_a_plain_version(spark, documents, labels, table):
    model = crf.learn(documents, labels)
    rows = [(i, t or "") for i, t in plain(table) if len(t or "") < 20_000]
    odd_lines = ["A B\n\nb a\nA b b b.", "\n", "x|y | z!\n" * 30 + "ÉCOLE ß 12%", "WE SHOUT\nwe shout\n" * 3]
    rows += [(1000 + k, t) for k, t in enumerate(odd_lines)]
    data, bounds = W.column(pa.record_batch({"text": pa.array([t for _, t in rows], pa.string())}))
    scored = crf.quality(*crf.lines(data, bounds), model) if rows else []
    assert np.allclose(scored, [brute.line_quality(t, model) for _, t in rows], atol=1e-9)


def test_samples_are_bounded_by_lines_and_bytes(spark, documents, labels):
    tables = store.Tables(spark)
    n_lines = crf.F.regexp_count("text", crf.F.lit("\n")) + 1
    every = sampling.labelled(documents, labels, "quality", "doc_id", "text", 4, 2, 4000, n_lines, 1 << 18, tables).collect()
    some = sampling.labelled(documents, labels, "quality", "doc_id", "text", 4, 2, 4000, n_lines, 640, tables).collect()
    few = sampling.labelled(documents, labels, "quality", "doc_id", "text", 4, 2, 7, n_lines, 1 << 18, tables).collect()
    size = {r.doc_id: r.text.count("\n") + 1 for r in every}
    assert len(few) == 7 and sum(r.text.count("\n") + 1 for r in some) <= 640 and all(r.text.count("\n") < 10 for r in some)
    whole = {r.doc_id: r.text.split("\n") for r in every}
    assert any(size[r.doc_id] > 10 for r in some) and all(set(r.text.split("\n")) <= set(whole[r.doc_id]) for r in some)
    assert {r.doc_id for r in few} | {r.doc_id for r in some} <= set(size) and all(brute.crc(i, 4) != 2 for i in size)
    hot = documents.crossJoin(spark.range(3).select("id")).drop("id")
    assert sorted(sampling.labelled(hot, labels, "quality", "doc_id", "text", 4, 2, 4000, n_lines, 1 << 18, tables).collect()) == sorted(every)


def test_marginals_agree_with_counting_all_labellings():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        good, ties = rng.normal(size=n), rng.normal(size=(2, 2))
        every = {y: sum(g for g, k in zip(good, y, strict=True) if k) + sum(ties[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=n)}
        total = np.logaddexp.reduce(list(every.values()))
        # next to another text, to see that they don't touch
        chance, pair_chance, totals = crf.marginals(np.concatenate([good, [1.0, 2.0]]), ties, np.array([0, n, n + 2]))
        assert totals[0] == pytest.approx(total)
        for k in range(n):
            assert np.exp(chance[k]) == pytest.approx(sum(np.exp(v - total) for y, v in every.items() if y[k]))
            if k + 1 < n:
                assert np.exp(pair_chance[k, 1, 0]) == pytest.approx(sum(np.exp(v - total) for y, v in every.items() if y[k] and not y[k + 1]))


def test_toxicity(spark, data, odd, twice, empty):
    documents = spark.read.parquet(f"{data}/../sf0.1/documents.parquet")
    known = spark.read.parquet(f"{data}/../sf0.1/labels.parquet")
    rows = toxicity.scores(documents, known).collect()
    label = {r.doc_id: r.toxic for r in known.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert auc(held, label) > 0.95 and np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    assert {r.held_out for r in rows if brute.crc(r.doc_id, 5) == 0} == {True}
    for table in (odd, twice, empty):
        some = toxicity.scores(table, known).collect()
        assert len(some) == table.count() and all(0 <= r.score <= 1 for r in some)
    assert {r.score for r in toxicity.scores(odd, known.limit(0)).collect()} == {0.5}


def test_toxicity_scores_equal_a_plain_version(documents, labels, table):
    model = toxicity.learn(documents, labels)
    assert len(model["kept"]) > 10
    rows = [t or "" for _, t in plain(table) if len(t or "") < 20_000]
    data, bounds = W.column(pa.record_batch({"text": pa.array(rows, pa.string())}))
    known = np.zeros(toxicity.SLOTS, bool)
    known[model["kept"]] = True
    scored = toxicity.toxicity(data, bounds, model, known)
    for text, score in zip(rows, scored, strict=True):
        words = brute.ALNUM.findall(brute.low(text))
        slots = {s for w in set(words) for s in toxicity.terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].tolist()}
        assert score == pytest.approx(brute.machine_chance(slots, model), abs=1e-9)


def test_terms_are_words_and_their_first_bytes():
    slots = lambda t: toxicity.terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    assert [len(slots("x" * n)) for n in (1, 4, 5, 6, 7, 40)] == [1, 1, 2, 3, 4, 4]
    assert slots("Abcdefgh")[1:] == slots("abcdefxyz")[1:] and slots("abcdefgh")[0] != slots("abcdefxyz")[0]
    assert len({*slots("abcdefgh")}) == 4 and slots("a-b") == slots("A") + slots("b")


def test_the_machine_learns_what_two_terms_mean_together():
    rng = np.random.default_rng(5)
    slots, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        slots.append(np.unique(np.array([1] * int(a) + [2] * int(b) + rng.integers(10, 60, 5).tolist(), np.int32)))
        label.append(int(a and b))
    model = toxicity.fit(slots, np.array(label))
    x = np.array([[1.0 * (k == s) for s in model["kept"]] for k in (1, 2)])
    score = lambda m: toxicity.machine(m[None], model["w0"][0], model["w"], model["v"])[0]
    together = score(x[0] + x[1]) - score(x[0]) - score(x[1]) + score(0 * x[0])
    assert score(x[0] + x[1]) > 0 > max(score(x[0]), score(x[1])) and together > 0.5


def test_the_machine_learns_a_pair_whose_terms_are_balanced_alone():
    rng = np.random.default_rng(6)
    slots, label = [], []
    for k in range(2000):
        # either term is in half of all toxic and half of all clean texts, both or neither of them only in toxic ones
        a = rng.random() < 0.5
        b = a if k % 2 else not a
        slots.append(np.unique(np.array([1] * int(a) + [2] * int(b) + rng.integers(10, 400, 20).tolist(), np.int32)))
        label.append(k % 2)
    label = np.array(label)
    assert not {1, 2} & set(toxicity.select_terms(slots, label).tolist())
    model = toxicity.fit(slots[:1500], label[:1500])
    score = toxicity.machine(toxicity.present(slots[1500:], model["kept"]).astype(float), model["w0"][0], model["w"], model["v"])
    assert np.mean((score > 0) == label[1500:]) > 0.95


def test_words_that_sums_of_powers_confuse(spark):
    """Thue-Morse words and their complements are different words to every operator that hashes words."""
    from test_words import thue_morse

    x, y = (f"{thue_morse(1024, *ab)}" for ab in ("ab", "ba"))
    rows = [(1, f"{x} b c d e f"), (2, f"{y} b c d e f"), (3, f"{x} " * 3 + "u v w"), (4, f"{y} " * 3 + "u v w"), (5, f"{x} {y} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring.remove_repeats(df, window=3, keep_text=False)) == same(brute.kept_words(rows, 3))
    assert got(near.near_groups(df, percent=80)) == same(brute.components(rows, percent=80))
    found = interpolation.scores(df).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    wanted = {r[0]: r for r in brute.base_scores(rows)}
    assert all(tuple(r)[:5] == wanted[r.doc_id][:5] and abs(r.base_score - wanted[r.doc_id][5]) < 1e-6 for r in found)


def test_labels_of_documents_that_are_not_there_change_no_model(spark, documents, labels):
    foreign = spark.range(10**7, 10**7 + 400_000).selectExpr("id as doc_id", "int(id % 2) as quality", "int(id % 2) as toxic")
    more = labels.select("doc_id", "quality", "toxic").unionByName(foreign)
    for learn in (crf.learn, toxicity.learn):
        a, b = learn(documents, labels), learn(documents, more)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_models_from_long_texts_alone(spark):
    """Texts above their share of the sample are learned from in stretches, and short ones are then told apart."""
    good = lambda k: "\n".join(f"The {j % 7} quiet rivers of town {k} run to the sea, and people walk there." for j in range(5000))
    bad = lambda k: "\n".join(f"$$$ {j} {j} BUY!!! ||| {k} @@@" for j in range(5000))
    docs = spark.createDataFrame([(k, (good if k % 2 else bad)(k)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    probe = spark.createDataFrame([(100, good(3)[:600]), (101, bad(3)[:600])], "doc_id long, text string")
    every = docs.unionByName(probe)
    quality = {r.doc_id: r.score for r in crf.scores(every, labels).collect()}
    assert quality[100] > 0.7 > 0.3 > quality[101]
    model = toxicity.learn(docs.withColumn("text", F.repeat("text", 4)), labels)
    assert len(model["kept"]) > 0


@pytest.mark.parametrize("shorten, size", [(sampling.some_lines, lambda t: t.count("\n") + 1), (sampling.some_letters, lambda t: len(t.encode()))])
def test_stretches(spark, shorten, size):
    texts = ["\n".join(f"line {k} é" * (k % 5) for k in range(300)), "x" * 5000, "\n" * 400, "é☃\n" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", shorten(F.col("text"), 64, F.col("doc_id")).alias("some")).collect():
        assert 0 < size(r.some) <= max(64, 8 if shorten is sampling.some_letters else 64) and set(r.some) <= set(r.text) | {" "}


def files_in(spark):
    from pathlib import Path

    return sorted(Path(store.shared_dir(spark)).glob("*/*"))


def test_tables_go_where_a_step_fails_and_once_a_result_is_written(spark, documents):
    before = files_in(spark)
    with pytest.raises(Exception, match="no more"):
        store.Tables(spark).cut(documents.select(F.when(F.col("doc_id") > 3, F.raise_error(F.lit("no more"))).otherwise("a")))
    assert files_in(spark) == before
    kept = store.Tables(spark)
    with store.collected():
        result = kept.cut(exact.copies(documents))
        assert len(files_in(spark)) > len(before) + 1
    kept.drop(result)
    assert len(files_in(spark)) == len(before)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default if name == "spark.checkpoint.dir" else spark.conf.get(name)

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext, _jvm, _jsc = Conf(), Context(), spark._jvm, spark._jsc

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        store.shared_dir(Session())
    Context.master = "local[4]"
    assert store.shared_dir(Session()).endswith("/cut")


def test_parts_of_a_language_model_are_small():
    import inspect

    assert inspect.signature(interpolation.scores).parameters["part_bytes"].default <= 16 << 20
