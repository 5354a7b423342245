import hashlib
import re

import numpy as np

from formgrain.llm.chain_dedup import Fenwick, chain, passages
from formgrain.llm.exact_dedup import exact_dedup, misra_gries
from formgrain.llm.graph import components
from formgrain.llm.minhash_dedup import block_links, near_dedup
from formgrain.llm import suffix_dedup
from formgrain.llm.suffix_dedup import LEVELS, WIDTH, common_prefix, repeated_windows, solve, substring_dedup, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def union(pairs, nodes):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in nodes}


def near_truth(rows, k, per_cent):
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in union(links, ids).items()}


def test_near_dedup_equals_brute_force(docs, rows):
    for k, per_cent in ((3, 85), (5, 80)):
        got = near_dedup(docs, k=k, per_cent=per_cent).collect()
        assert len(got) == len(rows)
        truth = near_truth(rows, k, per_cent)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == truth[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_near_dedup_of_a_group_whose_hub_is_no_middle(spark):
    import random

    from tests.llm.conftest import edited, prose

    rng = random.Random(9)
    base = prose(rng, 150)
    texts = [edited(rng, base, 8)] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(120)] + [base]
    rows = [(i, t) for i, t in enumerate(texts)]
    for block in (256, 10):  # one block of members, and many
        got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=3, per_cent=85, block=block).collect()}
        assert got == {i: r for i, (_, r) in near_truth(rows, 3, 85).items()}
    assert len(set(got.values())) > 1


def test_block_links_counts_common_edits():
    hub = list(range(100))
    members = [{"id": i, "r": i, "lacks": hub[:i], "adds": [1000 + j for j in range(i)], "n": 100} for i in range(1, 30)]
    found = block_links(100, members, members, 90)
    sets = {m["id"]: set(hub[m["id"] :]) | set(m["adds"]) for m in members}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert union(found, sets) == union(links, sets)


def test_near_dedup_of_nothing_and_with_other_columns(empty, docs, clash):
    assert near_dedup(empty).count() == 0
    assert sorted(map(str, near_dedup(clash, k=3, per_cent=85).collect())) == sorted(map(str, near_dedup(docs, k=3, per_cent=85).collect()))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 2), (20, 21), (21, 21), (30, 31), (31, 32), (30, 33)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert {x: got.get(x, x) for x in nodes} == union(edges, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_truth(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, rows, clash, empty):
    truth = exact_truth(rows)
    for source, counters in ((docs, 1024), (clash, 2)):  # few counters: most digests go by the shuffle
        got = exact_dedup(source, counters=counters).collect()
        assert len(got) == len(rows)
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in truth.items()}
        for r in got:
            assert (r.keep_id, r.group_size) == by[r.text_sha256]
            assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(empty).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    from collections import Counter

    total = Counter()
    for part in range(20):
        total = misra_gries(total, Counter([b"hot"] * 30 + [b"%d-%d" % (part, i) for i in range(60)]), 3)
    assert b"hot" in total and len(total) <= 3


def substring_truth(rows):
    count = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - WIDTH + 1):
            count[b[p : p + WIDTH]] = count.get(b[p : p + WIDTH], 0) + 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - WIDTH + 1):
            if count[b[p : p + WIDTH]] > 1:
                keep[p : p + WIDTH] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[1], keep.astype(int), [1]])) == -1)
        out.append((i, len(b), int((~keep).sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[keep])).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(docs, rows, clash, empty):
    for source in (docs, clash):
        got = substring_dedup(source).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == substring_truth(rows)
    assert substring_dedup(empty).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for symbols in (2, 5, 200):
        text = rng.integers(1, symbols + 1, 700).astype(np.uint16)
        text[[100, 300, 699]] = 0
        data = text.tolist()
        order = suffix_array(text, np.array([hash(tuple(data[i : i + WIDTH])) for i in range(700)], np.int64).view(np.uint64))
        assert sorted(order.tolist()) == list(range(700))
        keys = [data[i : i + WIDTH] for i in order]
        assert keys == sorted(keys)


def test_common_prefixes():
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 99, 900).astype(np.uint8)
    raw[400:700] = raw[100:400]
    a, b = rng.integers(0, 600, 300), rng.integers(0, 600, 300)
    a[:3], b[:3] = (100, 101, 7), (400, 401, 7)
    data = raw.tobytes()
    plain = lambda x, y: next((k for k in range(WIDTH) if data[x + k : x + k + 1] != data[y + k : y + k + 1]), WIDTH)
    assert common_prefix(raw, a, b, WIDTH).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_keys_of_any_size_give_the_same_windows(spark):
    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    shared, middle = some(260), some(150)
    pieces = [some(90) + shared + some(40 + i) for i in range(4)] + [some(80) + middle + some(80) for _ in range(12)] + [b"ab" * 150]
    pieces.append(some(60) + pieces[6])
    runs = np.array([len(x) - WIDTH + 1 for x in pieces])
    marks = repeated_windows(pieces, runs)
    rows = [(1, i, int(r), 1, bytearray(p)) for i, (p, r) in enumerate(zip(pieces, runs))]
    data = spark.createDataFrame(rows, "key long, print long, run int, copies long, bytes binary")
    want = {i: m.tolist() for i, m in enumerate(marks) if m.any()}
    for levels, most in ((LEVELS, 1 << 20), (LEVELS, 900), (1, 400), (0, 1)):
        got = {}
        for r in solve(data, most=most, levels=levels).collect():
            for a, b in zip(r.starts, r.ends):
                got.setdefault(r.print, np.zeros(runs[r.print], bool))[a:b] = True
        assert {i: m.tolist() for i, m in got.items()} == want


def test_very_long_texts_are_read_in_parts(spark, monkeypatch):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(6)
    monkeypatch.setattr(suffix_dedup, "FIND_BYTES", 1000)
    shared = prose(rng, 80)
    texts = [prose(rng, 700), f"{prose(rng, 300)} {shared} {prose(rng, 200)} {shared}", f"{shared} {prose(rng, 130)}", prose(rng, 20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == substring_truth(rows)
    assert sum(r.n_spans for r in got) >= 3


def test_chain_is_the_best_in_order():
    anchors = [(0, 10, 0, 10), (12, 20, 12, 20), (5, 9, 40, 44), (25, 40, 26, 41), (30, 34, 2, 6)]
    assert chain(anchors)[0] == [0, 1, 3]
    tree = Fenwick(5)
    for rank, value in ((3, 5.0), (1, 2.0), (4, 9.0)):
        tree.put(rank, value, rank)
    assert tree.top(4) == (5.0, 3) and tree.top(2) == (2.0, 1) and tree.top(5) == (9.0, 4)


def test_passages_are_found_and_clean_documents_left_alone(docs, rows, clash, empty):
    got = passages(docs).collect()
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    seen = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(i)
    sure = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    assert sure - {None} <= found
    clean = {i for i, *_ in rows if i is not None and 4 <= i < 24 and i not in sure}
    assert not clean & found
    for r in got:
        assert r.doc_id != r.other_id and r.identity >= 0.8 and r.end_word - r.start_word >= 45
    key = lambda rs: sorted(map(str, rs))
    assert key(passages(clash).collect()) == key(got)
    assert passages(empty).count() == 0


def spans(spark, texts):
    """Passages of texts whose ids are their places: (doc, other) -> [(start, end, other_start, other_end)]."""
    out = {}
    for r in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        out.setdefault((r.doc_id, r.other_id), []).append((r.start_word, r.end_word, r.other_start, r.other_end))
    return {k: sorted(v) for k, v in out.items()}


def test_a_chain_that_is_too_unlike_is_split_at_its_gaps(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(31)
    for length, gap in ((50, 30), (50, 50), (200, 120), (200, 300)):
        a, b = prose(rng, length), prose(rng, length)
        got = spans(spark, [f"{a} {b}", f"{a} {prose(rng, gap)} {b}"])
        near = lambda x, y: all(abs(u - v) <= 2 for u, v in zip(x, y))
        assert len(got[1, 0]) == 2
        assert near(got[1, 0][0], (0, length, 0, length)) and near(got[1, 0][1], (length + gap, 2 * length + gap, length, 2 * length))


def test_passages_with_words_changed_throughout(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(32)
    texts = []
    for i in range(40):
        a = prose(rng, 60).split()
        b = list(a)
        for j in rng.sample(range(60), 6) if i % 2 else range(5, 60, 6):  # one of ten at random, or every sixth
            b[j] = prose(rng, 1)
        texts += [f"{prose(rng, 30)} {' '.join(a)} {prose(rng, 30)}", f"{prose(rng, 30)} {' '.join(b)} {prose(rng, 30)}"]
    got = spans(spark, texts)
    assert set(got) <= {(i + 1, i) for i in range(0, 80, 2)}
    assert len(got) >= 38  # seeds of four words are thinned: a copy with every sixth word changed may share none
    assert all(len(x) == 1 for x in got.values())


def test_passages_of_which_an_earlier_document_has_a_part(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(33)
    texts = []
    for _ in range(8):
        passage = prose(rng, 60)
        texts += [f"{prose(rng, 20)} {' '.join(x)} {prose(rng, 20)}" for x in (passage.split()[:44], passage.split(), passage.split())]
    got = spans(spark, texts)
    for i in range(0, 24, 3):
        assert [x[1] - x[0] >= 60 for x in got[i + 2, i + 1]] == [True]


def plain_alignment(a, b):
    """Best local alignment of two word lists (match 1, else -1) by tables: its words in both, and its identity."""
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best, where = 0, (0, 0)
    for i, x in enumerate(a, 1):
        row, above = score[i], score[i - 1]
        for j, y in enumerate(b, 1):
            row[j] = max(0, above[j - 1] + (1 if x == y else -1), above[j] - 1, row[j - 1] - 1)
            if row[j] > best:
                best, where = row[j], (i, j)
    (i, j), same, columns = where, 0, 0
    while i and j and score[i][j]:
        columns += 1
        if score[i][j] == score[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return min(where[0] - i, where[1] - j), same / max(1, columns)


def overlapping_texts(rng):
    """Passages of which earlier and later documents hold overlapping parts, some with words changed."""
    from tests.llm.conftest import prose

    texts = []
    for k in range(6):
        passage = prose(rng, 90).split()
        parts = [passage[i : i + 30] for i in (0, 12, 24, 36, 48, 60)]
        holders = [*parts, passage, parts[2], passage, *parts[3:5], passage]
        for x in holders:
            x = list(x)
            for _ in range(len(x) // 12 if k >= 3 else 0):
                x[rng.randrange(len(x))] = prose(rng, 1)
            texts.append(" ".join([prose(rng, 12), *x, prose(rng, 12)]))
    return texts


def test_every_two_documents_with_a_passage_are_joined(spark):
    import random

    texts = overlapping_texts(random.Random(34))
    split = [words(t) for t in texts]
    wanted = []
    for i in range(len(texts)):
        for j in range(i):
            if len(set(split[i]) & set(split[j])) >= 36:
                size, identity = plain_alignment(split[i], split[j])
                if size >= 50 and identity >= 0.85:
                    wanted.append((i, j))
    found = passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root = union([(r.doc_id, r.other_id) for r in found], range(len(texts)))
    joined = [root[i] == root[j] for i, j in wanted]
    assert len(wanted) >= 15 and sum(joined) >= 0.95 * len(joined)
    verbatim = [(i, j) for i, j in wanted if i < 36]
    assert all(root[i] == root[j] for i, j in verbatim) and len(verbatim) >= 9
    for r in found:  # what is found is alike
        size, identity = plain_alignment(split[r.doc_id][r.start_word : r.end_word], split[r.other_id][r.other_start : r.other_end])
        assert size >= 40 and identity >= 0.78


def test_extension_and_gaps_equal_plain_tables():
    import random

    from formgrain.llm import chain_dedup as C

    rng = random.Random(12)
    rows = [([rng.randrange(3, 9) for _ in range(rng.randrange(0, 14))], [rng.randrange(3, 9) for _ in range(rng.randrange(0, 14))]) for _ in range(200)]
    flat = lambda k: np.array([x for r in rows for x in r[k]], np.int64)
    size = lambda k: np.array([len(r[k]) for r in rows])
    left, right = (C.Ranges(flat(k), np.cumsum(size(k)) - size(k), np.cumsum(size(k))) for k in (0, 1))
    pick = np.arange(200)
    common = C.in_parts(C._common, left, right, pick, 16, 1)[:, 0]
    for (a, b), got in zip(rows, common):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert got == table[-1][-1]
    for back in (False, True):
        best = C.in_parts(C._extend, left, right, pick, 16, 3, back)
        for (a, b), (m, n, same) in zip(rows, best.tolist()):
            a, b = (a[::-1], b[::-1]) if back else (a, b)
            score = lambda i, j: top_score(a[:i], b[:j])
            assert score(m, n) == max(score(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)) if len(a) * len(b) < 60 else True
            assert same <= min(m, n)


def top_score(a, b):
    """Score of the best alignment of two whole sequences (match 1, else -1)."""
    row = [-j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [-i]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
    return row[-1]


def test_frequent_seeds_are_dealt_to_groups_and_still_joined(spark, monkeypatch):
    import random

    from formgrain.llm import chain_dedup as C
    from tests.llm.conftest import prose

    rng = random.Random(35)
    passage = prose(rng, 70)
    texts = [f"{prose(rng, 8)} {passage} {prose(rng, 8)}" if i % 2 else prose(rng, 30) for i in range(120)]
    monkeypatch.setattr(C, "GROUP", 5)
    monkeypatch.setattr(C, "ASKS", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages(docs).collect()
    root = union([(r.doc_id, r.other_id) for r in found], range(120))
    assert {root[i] for i in range(1, 120, 2)} == {1} and all(root[i] == i for i in range(0, 120, 2))
    assert all(r.end_word - r.start_word >= C.LEAST_WORDS for r in found) and sum(r.end_word - r.start_word >= 70 for r in found) >= len(found) / 2


def test_copies_end_where_they_end(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(36)
    text = prose(rng, 70)
    rows = [(i, text) for i in range(6)]
    for parts in (1, 6):  # in one block, and each the first of its own
        found = passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        assert {(r.start_word, r.end_word, r.other_start, r.other_end, r.identity) for r in found} == {(0, 70, 0, 70, 1.0)}
        assert {r.doc_id for r in found} == set(range(1, 6))


def every_pair_texts(rng):
    """Passages with parts in earlier and later documents, words changed evenly, and seeds that a document has elsewhere too."""
    from tests.llm.conftest import prose

    texts = []
    around = lambda x, n=12: " ".join([prose(rng, n), *x, prose(rng, n)])
    for _ in range(4):  # 50 words, of which others hold 40 before, between and after
        passage = prose(rng, 50).split()
        texts += [around(x) for x in (passage[:40], passage, passage[10:], passage[:42], passage, passage[5:45], passage, passage[:44])]
    for every in (5, 6, 7, 10):  # two copies whose runs are short
        passage = prose(rng, 60).split()
        texts += [around(passage), around([prose(rng, 1) if i % every == every - 1 else x for i, x in enumerate(passage)])]
    for _ in range(3):  # its pieces stand in other order before the passage
        passage = prose(rng, 56).split()
        pieces = [passage[i : i + 7] for i in range(0, 56, 7)]
        rng.shuffle(pieces)
        texts += [around(passage), around([*(y for x in pieces for y in [prose(rng, 1), *x]), prose(rng, 40), *passage])]
    passage = prose(rng, 60).split()  # many holders, each with words of its own
    for _ in range(24):
        own = set(rng.sample(range(60), 3))
        texts.append(around([prose(rng, 1) if i in own else x for i, x in enumerate(passage)]))
    for _ in range(3):  # one run, and every other end half alike
        passage = prose(rng, 150).split()
        texts += [around(passage), around([x if 50 <= i < 100 or rng.random() < 0.62 else prose(rng, 1) for i, x in enumerate(passage)])]
    return texts


def test_every_two_different_texts_with_a_passage_have_a_row(spark):
    import random

    texts = every_pair_texts(random.Random(41))
    split = [words(t) for t in texts]
    wanted = set()
    for i in range(len(texts)):
        for j in range(i):
            sames = {tuple(split[j][k : k + 50]) for k in range(len(split[j]) - 49)}
            if any(tuple(split[i][k : k + 50]) in sames for k in range(len(split[i]) - 49)):
                wanted.add((i, j))
            elif len(set(split[i]) & set(split[j])) >= 36:
                size, identity = plain_alignment(split[i], split[j])
                if size >= 45 and identity >= 0.8:
                    wanted.add((i, j))
    found = {(r.doc_id, r.other_id) for r in passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(wanted) >= 280 and not wanted - found


def test_a_passage_of_any_number_of_texts_joins_each_to_the_smallest(spark, monkeypatch):
    import random

    from formgrain.llm import chain_dedup as C
    from tests.llm.conftest import prose

    monkeypatch.setattr(C, "GROUP", 4)
    rng = random.Random(42)
    passage = prose(rng, 50).split()
    whole = [i for i in range(90) if i % 3 == 1]
    texts = [" ".join([prose(rng, 10), *(passage if i % 3 == 1 else passage[:40] if i % 3 else passage[8:]), prose(rng, 10)]) for i in range(90)]
    copies = [texts[1], texts[1], texts[4]]
    found = passages(spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")).collect()
    root = union([(r.doc_id, r.other_id) for r in found if r.identity == 1.0 and r.end_word - r.start_word >= 50], range(93))
    assert {root[i] for i in whole} == {root[1]} and [root[i] for i in (90, 91, 92)] == [root[1]] * 3
    assert {(r.doc_id, r.other_id) for r in found if r.doc_id >= 90} == {(90, 1), (91, 1), (92, 4)}


def test_places_of_seeds_that_several_texts_have():
    from formgrain.llm import chain_dedup as C

    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**40, 50).astype(np.uint64)
    assert (C.joined(np.frombuffer(C.planes(x, 5).tobytes(), np.uint8), 5) == x).all()
    blob = lambda *columns: b"".join(C.planes(np.array(x, np.uint64), n).tobytes() for x, n in zip(columns, (5, 4, 3)))
    got = dict(C.shared_places([(7, blob([1, 2, 2, 5, 9, 16], [5, 6, 8, 7, 3, 4], [1, 2, 3, 4, 5, 6])), (8, blob([1, 4, 4, 5, 16], [0, 1 | 1 << 31, 9 | 1 << 31, 2, 3], [2, 7, 8, 4, 6]))]))
    assert {k: sorted(np.frombuffer(v, np.uint32).tolist()) for k, v in got.items()} == {7: [4, 5], 8: [0, 1, 3, 9]}  # 5 has one word before it everywhere


def test_links_are_sent_by_pairs_and_come_back_whole():
    from formgrain.llm import chain_dedup as C

    rng = np.random.default_rng(8)
    text, other = rng.integers(2**59, 2**59 + 9, 500), rng.integers(0, 5, 500) << 24
    p, q, size = rng.integers(0, 2**20, 500).astype(np.int32), rng.integers(0, 2**20, 500).astype(np.int32), rng.choice([4, 8, 16, 32, 45], 500)
    sent = list(C.links_out(iter([(text[:200], other[:200], p[:200], q[:200], size[:200]), (text[200:], other[200:], p[200:], q[200:], size[200:])]), 3))
    assert len(sent) <= 3  # one row for a bucket, where each link was a row
    got, buckets = [], {}
    for bucket, data in sent:
        a, b, times, x, y, z = C.links_in(data)
        got += zip(np.repeat(a, times).tolist(), np.repeat(b, times).tolist(), x.tolist(), y.tolist(), z.tolist())
        for i in a.tolist():
            assert buckets.setdefault(i, bucket) == bucket
    assert sorted(got) == sorted(zip(text.tolist(), other.tolist(), p.tolist(), q.tolist(), size.tolist()))
    for n in (5, 300):  # of a pair with many chains some in each row
        p, q = np.arange(n) * 400, np.arange(n)[::-1] * 400
        rows = list(C.pair_chains([(np.array([7]), np.array([3]), np.array([n]), p, q, np.full(n, 45))]))
        assert [x for b in rows for x in b.column(3).to_pylist()] == ([n] if n <= C.PIECE else [C.PIECE, n - C.PIECE])
        found = [C.Chains(b) for b in rows]
        assert sorted(zip(np.concatenate([x.x0 for x in found]).tolist(), np.concatenate([x.y0 for x in found]).tolist())) == sorted(zip(p.tolist(), q.tolist()))


def test_words_around_chains_are_sent_once_and_parts_are_aligned_together(monkeypatch):
    import pyarrow as pa

    from formgrain.llm import chain_dedup as C

    rng = np.random.default_rng(9)
    rows, a, b = [], [], []
    for k in range(60):  # two runs of 50 words, and 60 others between them on one side
        x, y = rng.integers(10, 2**31, 50), rng.integers(10, 2**31, 50)
        own, other = [rng.integers(10, 2**31, 20), x, y, rng.integers(10, 2**31, 20)], [rng.integers(10, 2**31, 5), x, rng.integers(10, 2**31, 60), y]
        a.append(np.concatenate(own))
        b.append(np.concatenate(other))
        rows.append([20, 70, 5, 70, 120, 115])
    edge = np.arange(61)
    batch = pa.RecordBatch.from_arrays([C.binaries(np.full(60, 2), edge), C.binaries(np.array(rows).ravel(), 6 * edge)], ["counts", "anchors"])
    chains = C.Chains(batch)
    row, low, high = chains.around(chains.x0, chains.x1)
    own, start, stop = C.covered(row, low, np.minimum(high, 140))
    assert own.tolist() == sorted([*range(60)] * 2) and set(zip(start.tolist(), stop.tolist())) == {(0, 20), (120, 140)}
    words = np.concatenate([a[i][s:e] for i, s, e in zip(own, start, stop)])
    cut = np.searchsorted(own, edge)
    batch = batch.append_column("parts", C.binaries(np.stack([start, stop], axis=1).ravel(), 2 * cut)).append_column("words", C.binaries(words, np.append(0, np.cumsum(stop - start))[cut]))
    ours = C.sent_words(batch, row, low, high)
    assert all((ours.flat[ours.first[3 * i] : ours.last[3 * i]] == a[i][:20]).all() and ours.sizes(np.arange(3 * i, 3 * i + 3)).tolist() == [20, 0, 20] for i in range(60))
    row, low, high = chains.around(chains.y0, chains.y0 + chains.x1 - chains.x0)
    at = row * 165
    theirs = C.Ranges(np.concatenate(b), at + low, at + np.minimum(high, 165))
    calls, extend = [], C.extend
    monkeypatch.setattr(C, "extend", lambda *x: calls.append(1) or extend(*x))
    which, found = C.align_chains(chains, ours, theirs)
    assert which.tolist() == sorted([*range(60)] * 2) and {tuple(x) for x in found[:, :4].tolist()} == {(20, 70, 5, 55), (70, 120, 115, 165)}
    assert len(calls) <= 10  # not some for each part
