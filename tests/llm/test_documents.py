"""Exact dedup, token counts, near duplicates, fuzzy lines and packing against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probscape.llm import line_dedup, near_dedup, packing, tokens
from probscape.llm.exact_dedup import directory, drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, lang string, key long, digest string, n long"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows):
    """Documents with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, "xx", 7, "d", None) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", *(f"w{k}" for k in range(400))]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 2, 3, 8, 40, 150]))) for i in range(60)]
    for i in range(60, 110):  # near copies, some of them of each other
        words = rows[rng.randrange(20, i)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(110, None), (111, ""), (112, " \t\n"), (113, rows[4][1].upper()), (114, rows[4][1].replace(" ", "\n\n")), (None, rows[5][1])]
    rows += [(115, "x" * 70_000), (116, "Ωmega \x85 é　日本 " * 9), (117, prose(rng, 9000)), (118, "x" * 70_000)]
    return rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(spark, corpus):
    rows = [*corpus, (200, "a b"), (201, "a  b"), (202, "ab"), (199, "ab ")]
    got = {r.doc_id: r for r in exact_dedup(table(spark, rows), capacity=3).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), 1 << 62 if i is None else i, i))
    assert len(got) == len(rows)
    for i, t in rows:
        group = groups[norm(t)]
        r = got[i]
        assert (r.keep_id, r.group_size) == (min(group)[2], len(group))
        assert r.kept == (i == min(group)[2]) and r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    kept = drop_copies(table(spark, rows)).collect()
    assert len(kept) == len(groups) and kept[0].lang == "xx"
    assert exact_dedup(table(spark, [])).count() == 0
    assert {(r.doc_id, r.group_size, r.kept) for r in exact_dedup(table(spark, [(1, "a"), (1, "a")])).collect()} == {(1, 2, True)}


def test_directory_doubles():
    counts = {0: 1, 1: 1, 7: 50, 6: 2}
    found = directory(counts, 3, 4)
    assert found[0] == found[1] == found[3] and found[7] != found[6] and len(set(found)) == 4
    assert len(set(directory({}, 4, 1))) == 1


def test_token_counts(spark, corpus):
    library = tokens.tokenizer(WORD)
    odd = [(300, "don't <|endoftext|> <|ENDOFTEXT|> Á H̱ it's,. 12.3"), (301, "(a).b,c.\x1cd\x85e"), (302, "İ ΑΣ ﬁ")]
    got = {r.doc_id: r for r in tokens.token_counts(table(spark, [*corpus, *odd]), WORD).collect()}
    for i, t in [*corpus, *odd]:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 2048)
    assert tokens.token_counts(table(spark, []), WORD).count() == 0


_bits = st.sampled_from(["a", "B", "'s", " ", "  ", "\n", "\n\n", "\t", "　", "é", "<|endoftext|>", "7", ".", ",", "!", "foo", "\x1c", "\x85", "日"])


@settings(max_examples=150, deadline=None)
@given(st.lists(_bits, max_size=25))
def test_unit_encoding(parts):
    text = "".join(parts)
    want = tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(packing.encode([text.encode()], BYTE)), "<u4").tolist() == want
    assert tokens.count_tokens([text.encode()], WORD) == [len(tokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids)]


def test_long_texts_are_cut_at_white_space():
    text = b"ab cd\nef " * 50
    assert b"".join(tokens.pieces(text, 16)) == text and all(p[:1] in b" \na" for p in tokens.pieces(text, 16))
    assert list(tokens.pieces(b"x" * 50, 16)) == [b"x" * 50]


def word_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j: j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return out


def classes(sets, percent=80):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, corpus, size):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, corpus), size).collect()}
    rows = [r for r in corpus if r[0] is not None]
    sets = word_sets(rows, size)
    want = classes(sets)
    assert len(set(want.values())) < len(want) - 20
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    assert got[None].component_id is None and got[None].kept
    kept = near_dedup.drop_near_copies(table(spark, corpus), size)
    assert kept.count() == len(set(want.values())) + 1 and kept.columns == table(spark, []).columns


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    got = near_dedup.near_duplicates(table(spark, [(2, "a b"), (1, "A B"), (1, "A B")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(2, 1, False), (1, 1, True)} and len(got) == 3


def test_chain_within_one_bucket(spark):
    """Neighbours are similar, the ends are not: no comparison with one centre finds all links."""
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(8):
        words = list(base)
        words[: 4 * i] = [f"x{k}" for k in range(4 * i)]
        rows.append((7 - i, " ".join(words)))
    want = classes(word_sets(rows, 2))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == want and set(want.values()) == {0}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = near_dedup.circulant_signature(pool[:2000], 480), near_dedup.circulant_signature(pool[1000:], 480)
    assert abs((a == b).mean() - 1 / 3) < 0.08


def line_set(line):
    return {line[i: i + 9] for i in range(max(1, len(line) - 8))}


def test_fuzzy_lines(spark):
    rng = random.Random(5)
    lines = [prose(rng, rng.choice([1, 3, 12, 40])) for _ in range(25)]
    lines += [" ".join(w if rng.random() > 0.03 else "edit" for w in x.split()) for x in lines for _ in range(2)]
    lines += ["", "  \t", "y" * 300, "y" * 299 + "z", "日本語のとても長い文章です" * 4]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [(40, None), (41, ""), (None, lines[0])]
    got = {(r.doc_id, r.line_no): r for r in line_dedup.fuzzy_lines(table(spark, rows)).collect()}
    places = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            places.setdefault(x.lower().strip(), []).append((i is None, i, n))
    groups = {}
    names = sorted(k for k in places if k)
    for name, root in classes({k: line_set(k) for k in names}).items():
        groups.setdefault(root, []).extend(places[name])
    assert sum(map(len, places.values())) == len(got)
    agree = 0
    for group in groups.values():
        first = min(group)[1:]
        agree += sum(((r := got[p[1:]]).keep_doc_id, r.keep_line_no, r.group_size, r.kept) == (*first, len(group), p[1:] == first) for p in group)
    assert agree >= 0.99 * sum(map(len, groups.values()))
    assert all(got[p[1:]].kept and got[p[1:]].group_size == 1 for p in places[""])
    clean = {r.doc_id: r.text for r in line_dedup.drop_lines(table(spark, rows)).collect()}
    assert clean[40] is None and clean[41] == "" and len(clean) == len(rows)
    assert clean[rows[0][0]].split("\n") == [x for n, x in enumerate(rows[0][1].split("\n")) if got[0, n].kept]
    assert line_dedup.fuzzy_lines(table(spark, [])).count() == 0


def test_packing(spark, corpus):
    rows = packing.pack(table(spark, corpus), BYTE).collect()
    library = tokens.tokenizer(BYTE)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            piece = np.array(ids[i][at: at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(ids[i]))
            at += r.length
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(map(len, ids.values())) // 2048)
    assert packing.pack(table(spark, []), BYTE).count() == 0
    assert packing.pack(table(spark, [(1, "a"), (1, "a"), (None, None)]), BYTE).count() == 3


def test_packing_memory_is_bounded():
    rows = [" ".join(f"w{(7 * i + j) % 900}x{i % 3}," for j in range(40)).encode() for i in range(900)]
    packing._memory(BYTE).clear()
    want = list(packing.encode(rows, BYTE))
    packing._memory(BYTE).clear()
    assert list(packing.encode(rows, BYTE, 500)) == want
    assert 250 <= len(packing._memory(BYTE)) <= 500
    packing._memory(BYTE).clear()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12))
def test_fill_is_the_best_sum(counts):
    counts = np.array([0, *counts])
    if not counts.any():
        return
    take = packing.fill(counts, 12)
    assert (take <= counts).all()
    first = int(np.flatnonzero(counts)[-1])
    rest = [n for n in range(1, 13) for _ in range(counts[n] - (n == first))]
    sums = {0}
    for n in rest:
        sums |= {s + n for s in sums if s + n <= 12 - first}
    assert (take * np.arange(13)).sum() == first + max(sums)


def test_plan_uses_every_piece():
    counts = np.random.default_rng(1).integers(0, 1000, 65)
    counts[0] = 0
    fillings = packing.plan(counts, 64)
    assert (sum(k * take for k, take in fillings) == counts).all() and len(fillings) < 400


def test_lines_are_compared_in_every_character(spark):
    """Equal beginnings of long words are not enough; links are those of plain character n-grams."""
    lines = ["https://www.foo.com", "https://www.bar.org", "2024-01-15t10:22:31", "2024-01-16t08:00:00", "id 100000000123456789", "id 100000000987654321",
             "日本語のとても長い文章です", "日本語のとても長い別の話", "short", "shorter", "🙂" * 3 + "abcdefgh" * 6, "🙂" * 3 + "abcdefgh" * 6 + "z"]
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.fuzzy_lines(table(spark, list(enumerate(lines)))).collect()}
    assert got == classes({i: {x[j: j + 9] for j in range(max(1, len(x) - 8))} for i, x in enumerate(lines)})
    assert len(set(got.values())) == len(lines) - 1


def test_similar_lines_share_a_band(spark):
    """Lines of 20 characters' shingles with similarity 18 / 22 meet in 99 of 100 cases and more."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=26))
        rows += [(2 * i, line + "!!"), (2 * i + 1, line + "??")]
    lines = line_dedup.lines_of(table(spark, rows))
    bands = {(r.h, r.g): r.bands for r in line_dedup.signatures(lines).collect()}
    of = {r.doc_id: set(bands[r.h, r.g]) for r in lines.select("doc_id", "h", "g").collect()}
    assert sum(bool(of[2 * i] & of[2 * i + 1]) for i in range(3000)) >= 0.99 * 3000


def test_repeated_ids(spark):
    """Rows under one id are texts of their own."""
    a, b = " ".join(f"a{k}" for k in range(13)), " ".join(f"b{k}" for k in range(13))
    rows = [(1, a), (1, b), (2, a + " nu"), (3, b + " fourteen"), (4, "other words here")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == {(1, 12): 1, (2, 13): 1, (3, 13): 1, (4, 2): 4}
    kept = drop_copies(table(spark, [(1, "x y"), (1, "ab"), (2, "a  b"), (2, None), (3, "")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(1, "x y"), (2, "a  b")] and [r.doc_id for r in kept if not r.text] == [2]
    lines = [(1, f"{a}\n{b}"), (1, f"{b}\nsame line"), (2, f"{a}x\nsame line!"), (2, None)]
    found = line_dedup.fuzzy_lines(table(spark, lines)).collect()
    assert len(found) == 7 and sorted(r.group_size for r in found) == [1, 1, 1, 2, 2, 2, 2]


def test_rare_pairs_order_what_components_share(spark):
    from probscape.llm.common import rare_pairs

    # two components of five near copies, each of which shares 3 of 10 items with one of the others; nodes 20 and 21 share 9
    rows = {i: (1, [*range(100, 107), *range(200 + 10 * i, 203 + 10 * i)]) for i in range(5)}
    rows |= {i: (10, [*range(300, 307), *range(100 + 10 * i, 103 + 10 * i)]) for i in range(10, 15)}
    rows |= {20: (20, [*range(400, 410)]), 21: (21, [*range(401, 411)])}
    nodes = spark.createDataFrame([(i, c) for i, (c, _) in rows.items()], "node long, component long")
    sets = spark.createDataFrame([(i, x) for i, (_, x) in rows.items()], "node long, items array<long>")
    for once in (False, True):
        assert {tuple(r) for r in rare_pairs(nodes, sets, 80, once).collect()} == {(20, 21)}
    rng = random.Random(5)
    rows = {i: (i // 3, sorted(rng.sample(range(14), 10))) for i in range(60)}
    nodes = spark.createDataFrame([(i, c) for i, (c, _) in rows.items()], "node long, component long")
    sets = spark.createDataFrame([(i, x) for i, (_, x) in rows.items()], "node long, items array<long>")
    alike = {(a, b) for a in rows for b in rows if a < b and rows[a][0] != rows[b][0] and 100 * len(set(rows[a][1]) & set(rows[b][1])) >= 80 * len(set(rows[a][1]) | set(rows[b][1]))}
    assert alike and alike <= {tuple(r) for r in rare_pairs(nodes, sets, 80, True).collect()}


def test_rare_pairs_by_slices(spark, monkeypatch):
    """The same pairs from a quarter of the items at a time; items with one hash lose no pair."""
    from probscape.llm.common import Stages, rare_pairs

    rng = random.Random(5)
    rows = {i: (i // 3, sorted(rng.sample(range(14), 10))) for i in range(60)}
    nodes = spark.createDataFrame([(i, c) for i, (c, _) in rows.items()], "node long, component long")
    alike = {(a, b) for a in rows for b in rows if a < b and rows[a][0] != rows[b][0] and 100 * len(set(rows[a][1]) & set(rows[b][1])) >= 80 * len(set(rows[a][1]) | set(rows[b][1]))}
    keep, written = Stages.keep, []

    def counted(self, df):
        written.append((out := keep(self, df)).count())
        return out

    monkeypatch.setattr(Stages, "keep", counted)
    for hashed in (False, True):
        sets = spark.createDataFrame([(i, [-(7 * k) % 11 if hashed else k - 9 for k in x]) for i, (_, x) in rows.items()], "node long, items array<int>")
        written.clear()
        found = {tuple(r) for r in rare_pairs(nodes, sets, 80, True, Stages(spark, "rare", tidy=True)).collect()}
        assert alike and alike <= found and (hashed or found == {tuple(r) for r in rare_pairs(nodes, sets, 80, True).collect()})
        assert sum(written[1:5]) == 600 and max(written[1:5]) < 300


def test_line_sets_are_not_stored(spark, monkeypatch):
    """No stage takes much more than the lines themselves: sets of hashes have eight bytes for every character."""
    from probscape.llm.common import Stages

    keep, sizes = Stages.keep, {}

    def measured(self, df):
        out = keep(self, df)
        folder = Path(out._stage_path.removeprefix("file:"))
        sizes[tuple(out.columns)] = sum(f.stat().st_size for f in folder.glob("*.parquet"))
        return out

    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900)) for _ in range(200)]
    monkeypatch.setattr(Stages, "keep", measured)
    found = line_dedup.fuzzy_lines(table(spark, [(2 * i + k, x + "!" * k) for i, x in enumerate(lines) for k in (0, 1)]))
    assert {r.doc_id: r.keep_doc_id for r in found.collect()} == {i: i // 2 * 2 for i in range(400)}
    assert max(sizes.values()) < 2 * 400 * 900, sizes


def test_pieces_and_items_of_lines(spark):
    """Cut from bytes, they are the nine characters from every character on, as a pattern gives them."""
    rng = random.Random(1)
    lines = ["a", "abcdefgh", "abcdefghi", "äbcdefgh", "äbcdefghiö", "🙂" * 3 + "abc", "🙂" * 12, "é" * 8, "x" * 30, "\x00abc\x01defghijk"]
    lines += ["".join(rng.choices("ab é日🙂ü.", k=rng.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "h long, g long, line string")
    want = {i: [x[j: j + 9] for j in range(max(1, len(x) - 8))] for i, x in enumerate(lines)}
    got = {i: [] for i in want}
    for r in line_dedup._pieces(df).collect():
        got[r.h].append(r.piece)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    items = {r.h: r.items for r in df.select("h", line_dedup._items(F.col("line")).alias("items")).collect()}
    assert {i: len(x) for i, x in items.items()} == {i: len(set(x)) for i, x in want.items()}
    assert len({x for part in items.values() for x in part}) == len({x for part in want.values() for x in part})
    bad = spark.sql("SELECT 1L AS h, 1L AS g, cast(X'80C3FF' AS string) AS line")
    assert line_dedup._pieces(bad).count() >= 1


def test_tidy_stages_leave_no_shuffle_files(spark):
    from probscape.llm.common import TIDY, Stages

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(TIDY)
    kept = Stages(spark, "tidy", tidy=True).keep(spark.range(100_000).selectExpr("id % 777 AS k").groupBy("k").count())
    assert files() <= before and spark.conf.get(TIDY) == setting and kept.count() == 777
