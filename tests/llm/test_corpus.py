"""The corpus operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagecensus.llm import (
    components, debruijn, fingerprints, forest, jaccard, licences, packing, pieces, pii, quality, queries, suffixes,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(12_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Grüße, Été ▁ naïve  two\n\nlines\x00 end "),
    (6, LONG), (7, LONG), (8, "日本語 テスト 😀     x"), (None, "no id at all"), (9, "twice"), (9, "twice"),
    (10, "<|endoftext|> a<|startoftext|>b <s> it's WE'RE"), (11, "a" * 5000), (12, "ab " * 3000),
]


def documents(spark, rows):
    """Documents with further columns, some of which have names the operators use."""
    full = [(i, t, None, None, None if t is None else len(t), "row", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def copies(seed: int, count: int, letters: str, lengths: list[int]) -> list[str]:
    """Random texts and edited, cut and joined copies of them."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(letters) for _ in range(rnd.choice(lengths))) for _ in range(count)]
    for _ in range(3 * count):
        words, others = rnd.choice(texts).split(" "), rnd.choice(texts).split(" ")
        if rnd.random() < 0.6:
            words[rnd.randrange(len(words))] = rnd.choice("XYZ")
        else:
            words = words[rnd.randrange(len(words)) :][:40] + others[:30]
        texts.append(" ".join(words))
    return texts


# ---- repeats ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 30), (2, "abcdé", 24)])
def test_suffix_repeats_match_brute_force(spark, seed, letters, size):
    texts = [*copies(seed, 25, letters, [0, 3, 20, 90]), "a" * 90, "a" * 31, None]
    docs = documents(spark, list(enumerate(texts)))
    found = suffixes.digests(suffixes.remove_repeats(docs, size, chunk_docs=9)).collect()
    wanted = suffixes.brute_force(texts, size)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == {
        i: (*w[:3], sha(w[3])) for i, w in enumerate(wanted)
    }


@pytest.mark.parametrize("hot", [1, 4])
def test_suffix_repeats_of_hot_anchors_match_brute_force(spark, hot):
    texts = [*copies(1, 25, "abcdé", [0, 3, 20, 90]), "a" * 90, "a" * 31, None]
    docs = documents(spark, list(enumerate(texts)))
    found = suffixes.remove_repeats(docs, 30, chunk_docs=9, hot_contexts=hot, min_words=40).collect()
    plain = suffixes.remove_repeats(docs, 30, chunk_docs=9, min_words=40).collect()
    assert {r.doc_id: r.kept for r in found} == {r.doc_id: r.kept for r in plain}
    alone = suffixes.remove_repeats(docs, 30, chunk_docs=9, hot_contexts=hot).collect()
    assert {r.doc_id: bytes(r.kept) for r in alone} == {i: w[3] for i, w in enumerate(suffixes.brute_force(texts, 30))}


def test_contexts_of_a_hot_anchor_are_not_sent_to_one_bucket():
    rnd = random.Random(4)
    other = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(400))
    footer = "".join(rnd.choice("ABCDEFGH ") for _ in range(300))
    texts = [f"{other()}{footer}{other()}" for _ in range(1500)]
    own = {"size": 400, "gram": 128, "bits": 3, "words": 0}
    tables = [
        pa.table({"doc_id": range(i, i + 500), "text": texts[i : i + 500], "chunk": pa.array([i // 500] * 500, pa.int32())})
        for i in (0, 500, 1000)
    ]
    anchors = pa.concat_tables([suffixes._send_anchors(t, **own) for t in tables])
    buckets = [anchors.filter(pc.equal(anchors.column("bucket"), b)) for b in range(8)]
    answers = pa.concat_tables([suffixes._answer_anchors(b, suffixes.HOT_CONTEXTS) for b in buckets])
    sent = [suffixes._send_contexts(t, answers.filter(pc.equal(answers.column("chunk"), i)), **own) for i, t in enumerate(tables)]
    rows = [r for r in pa.concat_tables(sent).to_pylist() if r["values"] is not None]
    contexts = np.bincount([r["bucket"] for r in rows], [len(r["keys"]) // suffixes._HEAD.itemsize for r in rows])
    assert contexts.max(initial=0) <= suffixes.HOT_CONTEXTS


def test_repeat_groups_have_all_occurrences(spark):
    texts = copies(5, 15, "abc", [40, 60])
    rows = suffixes.repeat_groups(documents(spark, list(enumerate(texts))), 30, chunk_docs=9).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
    assert groups
    for (_, length), places in groups.items():
        (string,) = {texts[d].encode()[s : s + length] for d, s in places}
        everywhere = {(d, s) for d, t in enumerate(texts) for s in range(len(t)) if t.encode().startswith(string, s)}
        assert places == everywhere and len(places) > 1
        before = {texts[d][s - 1] if s else d for d, s in places}
        # Not maximal to the left only if the windows of the anchor reach no further.
        assert len(before) > 1 or length >= 30


def test_documents_without_repeats_keep_columns(spark):
    same = "A sentence é that is long enough to count. " * 12
    docs = documents(spark, [(1, f"first {same}"), (2, f"other é{same} end"), (3, "short"), (4, None)])
    out = suffixes.without_repeats(docs, 100)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows[1].text) < 20 and rows[3].text == "short" and rows[4].text == "" and rows[2].row == "row"


def test_pipeline_cuts_short_passages_of_51_words(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passage, below = [word() for _ in range(51)], " ".join(word() for _ in range(50))
    own = [[" ".join(word() for _ in range(60)) for _ in range(3)] for _ in range(2)]
    assert 250 < len(" ".join(passage)) < 350
    texts = [f"{a} {p} {b} {below} {c}" for (a, b, c), p in zip(own, (" ".join(passage), "\n".join(passage)), strict=True)]
    docs = documents(spark, [*enumerate(texts), (2, " ".join(passage[:50])), (3, "a " * 50), (4, None)])
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for i, (a, b, c) in enumerate(own):
        assert out[i].split() == f"{a} {b} {below} {c}".split()
    assert out[2] == " ".join(passage[:50]) and out[3] == "a " * 50 and out[4] == ""


@pytest.mark.parametrize(("letters", "span"), [("ab", 9), ("abcde", 13)])
def test_repeated_runs_of_words_match_definition(spark, letters, span):
    texts = copies(6, 20, letters, [0, 5, 13, 60, 200])
    found = suffixes.remove_repeats(documents(spark, list(enumerate(texts))), 5000, chunk_docs=9, min_words=span).collect()
    split = [t.split() for t in texts]
    runs = [tuple(w[i : i + span]) for w in split for i in range(len(w) - span + 1)]
    often = {r for r in runs if runs.count(r) > 1}
    for r in found:
        words, gone = split[r.doc_id], set()
        for i in range(len(words) - span + 1):
            if tuple(words[i : i + span]) in often:
                gone.update(range(i, i + span))
        assert bytes(r.kept).decode().split() == [w for i, w in enumerate(words) if i not in gone]
    assert often


@pytest.mark.parametrize(("letters", "span", "chunk_docs"), [("ab", 9, 9), ("abcde", 13, 9), ("abcde", 13, 2000)])
def test_passages_of_other_documents_match_definition(spark, letters, span, chunk_docs):
    twice = " ".join(f"t{i}" for i in range(span))
    texts = [
        *copies(6, 20, letters, [0, 5, 13, 60, 200]), None, f"{twice} alone {twice}",
        *("é ".join(f"s{i}" for i in range(span + more)) for more in (0, 2)), " \n\t ", "x" * 99,
    ]
    rows = [(i % 7, t) for i, t in enumerate([*texts, "same row " * span, "same row " * span])]
    found = suffixes.remove_repeats(documents(spark, rows), 60, chunk_docs=chunk_docs, shared_words=span, hot_contexts=4)
    holders: dict = {}
    split = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for _, t in rows]
    runs = [[tuple(x[2] for x in w[i : i + span]) for i in range(len(w) - span + 1)] for w in split]
    for doc, own in enumerate(runs):
        for run in own:
            holders.setdefault(run, set()).add(doc)
    wanted = []
    for (doc_id, text), words, own, whole in zip(rows, split, runs, suffixes.brute_force([t for _, t in rows], 60), strict=True):
        gone = bytearray(len((text or "").encode()))
        for i, run in enumerate(own):
            if len(holders[run]) > 1:
                begin, end = words[i][0], words[i + span - 1][1]
                gone[begin:end] = b"\1" * (end - begin)
        passages = [m.end() - m.start() for m in re.finditer(b"\1+", gone)]
        wanted.append((doc_id, *whole[:3], sha(whole[3]), len(passages), sum(passages)))
    assert sorted(tuple(r) for r in suffixes.digests(found).collect()) == sorted(wanted)
    assert any(w[-1] for w in wanted) and any(len(r) > len(set(r)) for r in runs)


def test_op1_tells_short_passages_of_51_words(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passage, below, twice = (" ".join(word() for _ in range(n)) for n in (51, 50, 51))
    assert len(passage) < 350
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{passage} {own[2]}", f"{own[3]} {below}", f"{below} {own[4]}", f"{twice} {own[5]} {twice}"]
    documents(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op1_suffix_repeats(spark, str(tmp_path)).collect()}
    assert {i: (r.n_removed, r.n_passages, r.n_passage_bytes) for i, r in rows.items()} == {
        **dict.fromkeys((0, 1), (0, 1, len(passage))), **dict.fromkeys((2, 3, 4), (0, 0, 0)),
    }
    assert all(r.kept_sha256 == sha(texts[i]) for i, r in rows.items())


@pytest.mark.parametrize(("seed", "letters", "span"), [(3, "ab", 6), (4, "abcde", 13)])
def test_debruijn_matches_brute_force(spark, seed, letters, span):
    rnd = random.Random(seed)
    texts = copies(seed, 25, letters, [0, 5, 13, 60, 200])
    rows = [(rnd.choice([i, i, i // 2, None]), t) for i, t in enumerate(texts)] + [(3, None)]
    found = debruijn.digests(debruijn.remove_repeats(documents(spark, rows), span, chunk_docs=7)).collect()
    wanted = [(str(i), *w) for (i, _), w in zip(rows, debruijn.brute_force(rows, span), strict=True)]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(wanted)


# ---- near copies ------------------------------------------------------------------------------


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1024), (3, 70, 3)])
def test_jaccard_matches_brute_force(spark, words, percent, block):
    texts = copies(7, 35, "abcdefghijk", [1, 3, 5, 8, 12, 40, 100])
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, texts[0].upper())]
    found = jaccard.similar_documents(documents(spark, rows), words, percent, chunk_docs=40, block_sets=block)
    wanted = jaccard.brute_force(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == wanted
    assert any(d != c for d, (_, c) in wanted.items())


def test_boundary_follows_cost():
    assert jaccard.boundary(85, 1) < jaccard.boundary(85, 3) < jaccard.boundary(85, 10)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = documents(spark, [(5, text), (3, text), (4, f"{text} more"), (6, "else"), (7, None), (None, text)])
    left = jaccard.one_of_each(docs)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "6", "7", "None"]
    assert left.columns == docs.columns


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 2), (8, 7), *((20, i) for i in range(21, 60))]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    wanted = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(20, 60), 20)}
    assert {r.node: r.component for r in found.collect()} == wanted
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"leaf_size": 16, "cell_size": 150, "block": 12}])
def test_forest_finds_links(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(200)]
    rows += [(200 + i, (np.array(rows[i % 40][1]) + 0.05 * rng.standard_normal(16)).tolist(), (i % 40) % 3) for i in range(150)]
    rows += [(400, rows[0][1], 0), (401, None, 1), (402, [0.0] * 16, 1), (403, rows[0][1], None), (404, [float("nan")] * 16, 0)]
    rows += [(405, [1.0, None], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in forest.near_duplicates(vectors.withColumn("key", F.lit(1)), **sizes).collect()}
    wanted = forest.brute_force(rows)
    assert set(found) == set(wanted)
    assert all(found[i].n_links <= n for i, (n, _) in wanted.items())
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(n for n, _ in wanted.values()) > 0
    assert all(r.kept == (r.component_id == r.vec_id) for r in found.values())
    assert found[401].n_links == found[402].n_links == found[403].n_links == found[404].n_links == 0


def test_forest_keeps_a_dense_cluster_out_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.005 * rng.standard_normal(16)).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rng.standard_normal(16).tolist(), 1) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    split = forest._leaf_rows

    def of_small_cells(rows, least, leaf_size):
        assert rows.num_rows <= 100
        return split(rows, least, leaf_size)

    monkeypatch.setattr(forest, "_leaf_rows", of_small_cells)
    found = forest.near_duplicates(vectors, cell_size=100, block=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == forest.brute_force(rows)


# ---- tokens -----------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.digests(pieces.decode(pieces.encode(documents(spark, ODD), PIECES), PIECES)).collect()
    wanted = []
    for i, text in ODD:
        ids = library.encode(text or "")
        wanted.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(wanted)


def test_packing_is_gapless_and_exact(spark):
    from tokenizers import Tokenizer

    rows = packing.pack(documents(spark, [*ODD, *((100 + i, LONG[: 37 * i]) for i in range(60))]), WORDS).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    windows: dict = {}
    pieces_of: dict = {}
    for r in rows:
        windows.setdefault((r.sequence_id, r.sequence_length), []).append((r.offset, r.length))
        pieces_of.setdefault(r.doc_id, []).append(r)
    for (_, length), own in windows.items():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] == length and length & (length - 1) == 0
    for i, text in [*ODD[:8], ODD[11]]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces_of[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and own[0].doc_tokens == len(ids)


# ---- fingerprints -----------------------------------------------------------------------------


def test_fingerprints_of_edited_and_next_texts(spark):
    rows = [*ODD, *((200 + i, t) for i, t in enumerate(copies(9, 20, "abcdefghijklmnop", [30, 200, 400])))]
    found = fingerprints.compared_with_edits(documents(spark, rows)).collect()
    ordered = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows))
    wanted = []
    for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        cut = len(text) // 4
        wanted.append(("None" if i == -(2**63) else str(i), len(text), sha(text[: len(text) - cut] + following[:cut])))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(wanted)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[6] == prints[7] != prints[8] and prints[1] == prints[2] == ""
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert next(r.near_next for r in found if r.doc_id == 6) == 1


def test_syncmers_are_context_free():
    inside = b"the same passage in the middle of two texts, long enough for anchors"
    a, b = b"first beginning " + inside + b" end", b"another and longer beginning " + inside
    shifts = {y - x for x, y in fingerprints.matches(a, b) if 16 <= x < 16 + len(inside) - 12}
    assert shifts == {13}


# ---- licences, quality, personal data ----------------------------------------------------------


def test_licence_scan_matches_brute_force(spark):
    notices = [t for _, t in licences.TEMPLATES]
    rows = [(i, f"Some words before.\n{t}\n\nAnd after it, more text here.") for i, t in enumerate(notices)]
    rows += [(100, notices[3].upper().replace(".", " ;")), (101, "the license of the work is not here"), *ODD[:4]]
    found = {(r.doc_id, r.licence, r.start, r.length) for r in licences.scan(documents(spark, rows)).collect()}
    wanted = set()
    for i, text in rows:
        for _, start, part in licences.parts((text or "").encode()):
            for name, template in licences.TEMPLATES:
                own, other = licences.bigrams(part), licences.bigrams(template.encode())
                if len(own) and licences.dice(own, other) >= licences.LEAST_DICE:
                    wanted.add((i, name, start, len(part)))
    assert found == wanted and {100, *range(len(notices))} <= {m[0] for m in found}
    assert licences.licences(licences.scan(documents(spark, rows))).count() >= len(notices)


def test_licence_scan_finds_wrapped_and_embedded_notices(spark):
    def wrapped(text, mark, width=9):
        words = text.split()
        return "\n".join(f"{mark} {' '.join(words[i : i + width])}" for i in range(0, len(words), width))

    named = {name: text for name, text in licences.TEMPLATES if len(text) > 100}
    gpl = (
        named["GPL-3.0-or-later"] + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.\n\nYou should have received a copy of the GNU General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>."
    )
    rows, wanted = [], {}
    for name, text in [*named.items(), ("GPL-3.0-or-later", gpl)]:
        for before, mark, after in (
            ("# Copyright 2020 A. Person\n#\n", "#", "\n#\nimport os\nprint(os.name)"),
            ("/*\n * Copyright (c) 2001 Somebody Else\n", " *", "\n */\nint main(void) { return 0; }"),
            ("Prose goes on and on here, and then at once ", "", " and it goes on after that for a good while longer."),
        ):
            wanted[len(rows)] = name
            rows.append((len(rows), before + wrapped(text, mark) + after))
    for name, text in licences.full_texts():
        wanted[len(rows)] = name
        rows.append((len(rows), f"some code; x = 1\n{wrapped(text, '//')}\nmore of it; y = 2"))
    rows += [(1000, "A story of this software, and of the terms and conditions of the work. " * 50)]
    found: dict = {}
    for r in licences.scan(documents(spark, rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
    assert {i: n for i, n in wanted.items() if n not in found.get(i, set())} == {} and 1000 not in found


def test_quality_on_held_out_labels(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randrange(8, 60))]
        rows.append((i, " ".join(w + "$$" if bad and rnd.random() < 0.7 else w for w in words), "en", f"s{i % 7}", 1))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, truth)
    kept = {r.doc_id for r in quality.posteriors(docs, model).where("_good >= 0.5").collect()}
    right = sum((i in kept) == (i % 4 != 0) for i in range(1, 900, 2))
    assert right / 450 > 0.97
    assert quality.keep_good(docs, truth).columns == docs.columns
    assert quality.keep_good(docs, truth.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), truth).count() == 0


def test_sites_shrink_towards_the_prior(spark):
    model = quality.Model(0.0, np.empty(0, dtype=np.uint64), np.empty(0))
    rows = [("big", "p", 4.0)] * 200 + [("bad", "p", -4.0)] * 200 + [("tiny", "p", -4.0), (None, None, 4.0)]
    shares = quality.site_shares(spark.createDataFrame(rows, "h string, p string, _evidence double"), model, "h", "p")
    share = {r._host: r.path_share for r in shares.collect()}
    assert share["big"] > 0.9 > 0.5 > share["tiny"] > share["bad"]


def test_surrogates_hide_and_keep_identity(spark):
    mail, card = "jane.doe7@mail3.example.com", "4111 1111 1111 1111"
    rows = [
        (1, f"Write to {mail}, card {card}, from 10.1.2.3 or 93.184.216.34."),
        (2, f"{mail} again; +1 (974) 555-3436. Mr. John Smith met Anna Karenina and Иван Петров."),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 2024-01-31 version 2.0, 1,000'),
        (4, None), (5, ""), (6, "nothing here 123"),
    ]
    out = pii.with_surrogates(documents(spark, rows), "key")
    found = {r.doc_id: r for r in out.collect()}
    assert found[4].text is None and found[5].text == "" and found[6].text == rows[5][1]
    entities = [e for r in found.values() for e in r._entities]
    kinds = sorted(e.kind for e in entities)
    assert kinds == ["card", "ip", "ip", "mail", "mail", "person", "person", "person", "phone", "secret"]
    assert not any(e.entity in r.text for r in found.values() if r.text for e in entities)
    assert len({e.surrogate for e in entities if e.kind == "mail"}) == 1
    made = {e.entity: e.surrogate for e in entities}
    assert pii._luhn(made[card]) and made["10.1.2.3"].split(".")[0] in ("10", "127", "172", "192")
    assert made["Anna Karenina"].split()[0] in pii._GIVEN["Anna"] and made["Иван Петров"].split()[0] in pii._GIVEN["Иван"]
    assert set(made["04dbebab91ab85687d33eeaaf9ac699e1188f962"]) <= set("0123456789abcdef")
    assert pii.collisions(out).count() == 0


def test_permutations_are_one_to_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(b"k", "label", i, size) for i in range(size)) == list(range(size))


# ---- all of them ------------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, []).drop("row", "chunk")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_texts_pass_every_stage(spark, tmp_path):
    rows = [(i, t, None, "s", None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(4, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {str(r.doc_id): r.text for r in docs.collect()}
    assert "7" not in left and left["6"] and left["None"] == "no id at all"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
