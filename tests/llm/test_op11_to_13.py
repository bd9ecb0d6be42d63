"""Fill-in-middle, token files and hard negatives against brute force, round trips and odd rows."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from conftest import DATA
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsignals.llm import op11_fill_in_middle as op11
from logsignals.llm import op12_token_files as op12
from logsignals.llm import op13_hard_negatives as op13
from logsignals.llm import run_codes, textual

BIG = (1 << 53) + 1
ODD = ["", " ", "one", " lead and trail ", "a b 　c", "文字列 です\n\n", "<P> in a text", "half <P <S> here", "<M", "<P<M>", ">P>", "x\0y \0", "tab\tand\x0bmore\x0c", "é" * 300, "word " * 40_000, "w" * 200_000, "<", "<<S", "ends with <", "it's, <|endoftext|> don't. x", "Å. Ḃ, İ! K"]


def _plain_fim(doc_id, text, seed=42):
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, str(rng.choice(ODD)) + "".join(rng.choice(list("ab <>PSM\té\n"), int(rng.integers(0, 30))))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (BIG, "large id here"), (BIG, "large id here"), (7, None), (-3, "below zero")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in op11.restore(op11.fill_in_middle(docs)).collect())
    assert got == collections.Counter((i, *_plain_fim(i, t or ""), t or "") for i, t in rows)
    assert {f for _, _, f, *_ in got} == set(op11.FORMS)
    assert op11.restore(op11.fill_in_middle(docs.limit(0))).count() == 0
    other = {r.doc_id: r for r in op11.fill_in_middle(docs.filter("doc_id < 400"), seed=7, rate=100, spm_rate=0).collect()}
    assert all(r.form in ("psm", "plain") for r in other.values()) and sum(r.form == "psm" for r in other.values()) > 200


def test_fill_in_middle_in_groups_of_any_size(monkeypatch):
    texts = [*ODD, *ODD[::-1]]
    for group in (1, 100, 10**9):
        monkeypatch.setattr(op11, "GROUP", group)
        n = len(texts)
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts, "h1": [i * 7 for i in range(n)], "h2": [i * 3 + 1 for i in range(n)], "chosen": [i % 3 > 0 for i in range(n)], "spm": [i % 2 > 0 for i in range(n)]})
        outs = [o for part in op11._scatter([batch.slice(3)]) for o in part.column("output").to_pylist()]
        forms = [o for part in op11._scatter([batch.slice(3)]) for o in part.column("form").to_pylist()]
        data, starts = op11._flat(pa.array(outs))
        back, at = op11.restored(data, starts, np.array([op11.FORMS.index(f) for f in forms]))
        assert [back[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts[3:]
    with pytest.raises(ValueError, match="three marks"):
        op11.restored(*op11._flat(pa.array(["<P>a<S>b"])), np.array([1]))


def _flat(texts):
    held = [t.encode() for t in texts]
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def test_codes_of_runs_are_those_of_the_library(spark):
    path = public_tokenizers.path(op12.VOCABULARY)
    library, coder = Tokenizer.from_file(path), run_codes.RunCodes(path)
    texts = [*ODD, *(r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())]
    texts += [f"{a}{chr(m)}. {a}x{chr(m)}, {chr(m)}{a}" for a in "AEIOUKSaz" for m in range(0x300, 0x370)]
    texts += [f"a{chr(c)}B {chr(c)} 1{chr(c)}. {chr(c)}," for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for again in range(2):
        ids, sizes = coder.codes(*_flat(texts), end_id=1)
        ends = np.cumsum(sizes)
        for t, e, n in zip(texts, library.encode_batch(texts, add_special_tokens=False), zip(ends - sizes, ends)):
            assert ids[n[0] : n[1]].tolist() == [*e.ids, 1], t[:60]
    coder.n = run_codes.REMEMBERED + 1  # forgets all
    assert coder.codes(*_flat(texts[:50]))[0].tolist() == [i for t in texts[:50] for i in library.encode(t, add_special_tokens=False).ids]
    assert [len(x) for x in coder.codes(*_flat([]))] == [0, 0] and coder.codes(*_flat(["", ""]), end_id=1)[0].tolist() == [1, 1]
    with pytest.raises(ValueError, match="white space"):
        run_codes.RunCodes(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_hold_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    library, at = Tokenizer.from_file(public_tokenizers.path(op12.VOCABULARY)), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op12.op12(spark, DATA).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert got.pop(r.doc_id) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_token_files_of_odd_rows(spark):
    rows = [(None, "no id"), (5, None), (BIG, "large"), (5, ""), (-2, "below"), (5, "more of five"), (5, "more of five"), (None, None), (3, "many words " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, file string")
    path, library = public_tokenizers.path(op12.VOCABULARY), Tokenizer.from_file(public_tokenizers.path(op12.VOCABULARY))
    manifest = op12.write_token_files(docs, f"{textual.shared_folder(spark)}/odd-tokens", path, parts=3)
    got = sorted(op12.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -2, 3, 5, 5, 5, 5, BIG] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    told = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert told == collections.Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows)
    some = op12.read_token_files(manifest, [5, 3, 99]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == sorted((r.doc_id, r.start) for r in got if r.doc_id in (3, 5))
    assert op12.read_token_files(manifest, []).count() == 0
    empty = op12.write_token_files(docs.limit(0), f"{textual.shared_folder(spark)}/no-tokens", path)
    assert empty.count() == 0 and op12.read_token_files(empty).count() == 0


def test_token_file_format():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 5, 70_000, 1, 200_000, 3, 0, 90_000, 10] + [700] * 300)
    ids = rng.integers(0, 49_000, sizes.sum()).astype(np.uint16)
    ends = np.cumsum(sizes)
    for width in (2, 4):
        sink = io.BytesIO()
        writer = op12.TokenFileWriter(sink, width)
        for low in range(0, len(sizes), 7):
            part = slice(low, low + 7)
            writer.add(np.arange(low, low + len(sizes[part])), np.ones(len(sizes[part]), bool), ids[(ends - sizes)[low] : ends[part][-1]], sizes[part])
        told = writer.close()
        whole = sink.getvalue()
        assert told == {"docs": len(sizes), "ids": len(ids), "bytes": len(whole), "first_id": 0, "last_id": len(sizes) - 1}
        streamed = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
        assert streamed == ids.astype(f"<u{width}").tobytes()  # any reader of zstandard sees the ids
        reader = op12.TokenFileReader(io.BytesIO(whole), len(whole))
        assert 4 < len(reader.table) <= 2 + len(ids) // op12.FRAME and reader.table[:-1, 1].max() <= 2 * op12.FRAME * width
        assert reader.document(20).tolist() == ids[ends[19] : ends[20]].tolist() and reader.opened == 1  # one frame of many
        for k in range(len(sizes)):
            assert reader.document(k).tolist() == ids[ends[k] - sizes[k] : ends[k]].tolist()
        bad = bytearray(whole)
        bad[100] ^= 1
        with pytest.raises((zstandard.ZstdError, ValueError)):
            op12.TokenFileReader(io.BytesIO(bytes(bad)), len(bad)).document(2)
        table = bytearray(whole)
        table[-9 - 12 * len(reader.table) + 8] ^= 1  # the checksum of the first frame
        with pytest.raises(ValueError, match="seek table"):
            op12.TokenFileReader(io.BytesIO(bytes(table)), len(table)).document(1)
        with pytest.raises(ValueError, match="without a seek table"):
            op12.TokenFileReader(io.BytesIO(whole[:-1]), len(whole) - 1)


def test_files_that_no_manifest_lists_are_not_read(spark):
    folder = f"{textual.shared_folder(spark)}/left-tokens"
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    manifest = op12.write_token_files(docs, folder, public_tokenizers.path(op12.VOCABULARY), parts=2)
    system, place = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{place}/lost.zst", compression=None) as f:
        f.write(b"what a lost executor wrote")
    assert op12.read_token_files(manifest).count() == 50


def _brute_negatives(rows, k=5, m=10):
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (i, label, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(int(np.dot(np.array(v[: len(w)], object), np.array(w[: len(v)], object))) if len(v) and len(w) else 0, j, other) for b, (j, other, w) in enumerate(rows) if b != a]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:k]:
            own = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:m]
            out += [(i, p, n + 1, j, ps, s) for n, (s, j, _) in enumerate(own)]
    return collections.Counter(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("kind", ["dense", "sparse", "hot", "large", "few"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, d = (12, 5) if kind == "few" else (900, 33)
    v = rng.normal(0, 60, (n, d)).astype(int)
    if kind == "sparse":
        v[rng.random((n, d)) < 0.8] = 0
    if kind == "hot":
        v[rng.random(n) < 0.4] = v[0]
    if kind == "large":
        v = v * 400_000
    ids = rng.permutation(n) * (100 if kind == "few" else 10) if kind != "sparse" else rng.integers(0, 400, n)
    rows = [(int(i), int(x), w.tolist()) for i, x, w in zip(ids, rng.integers(0, 4, n), v)]
    if kind == "sparse":
        rows += [(None, 1, rows[0][2]), (None, 2, rows[1][2]), (300, 2, []), (301, 2, [5, -7])]
    got = op13.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, v array<long>"), F.col("vec_id") % 100 == 0)
    assert collections.Counter(tuple(r[c] for c in NEGATIVES) for r in got.collect()) == _brute_negatives(rows)


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(op13, "ROWS", 20)
    monkeypatch.setattr(op13, "ANCHORS", 3)
    monkeypatch.setattr(op13, "TILE", 50)
    rows = [(i, int(i % 3), (rng.normal(0, 9, 20) * (1 + i % 5)).astype(int).tolist()) for i in range(0, 4000, 10)]
    got = op13.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, v array<long>"), F.col("vec_id") % 100 == 0)
    assert collections.Counter(tuple(r[c] for c in NEGATIVES) for r in got.collect()) == _brute_negatives(rows)


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.5, -0.001], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (8, [1e30, 1.0], 2), (9, [0.3, 0.3], 2)]
    vectors = spark.createDataFrame([(i, e, x, "clash") for i, e, x in rows], "vec_id long, embedding array<float>, label int, anchor_id string")
    whole = op13.whole_numbers(vectors)
    assert {r.vec_id: r.v for r in whole.collect() if r.vec_id < 8} == {0: [256, 128], 1: [128, 64], 2: [128, -1]}
    got = op13.hard_negatives(whole, F.col("vec_id") == 0).collect()
    assert sorted(tuple(r[c] for c in NEGATIVES) for r in got) == [(0, 1, 1, 2, 40960, 32640), (0, 1, 2, 9, 40960, 76 * 256 + 76 * 128)]
    assert op13.hard_negatives(whole.limit(0), F.col("vec_id") == 0).count() == 0


def test_index_leaves_out_what_norms_cover():
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 50, (40, 64)).astype(int).astype(float), rng.normal(0, 50, (500, 64)).astype(int).astype(float)
    index, scores = op13.Index(y), x @ y.T
    for share in (0.05, 0.3, 0.9):
        least = np.quantile(scores, 1 - share) * np.ones(40)
        i, r, s = index.reach(x, least)
        want = np.nonzero(scores >= least[:, None])
        assert sorted(zip(i, r)) == sorted(zip(*want)) and (s == scores[i, r]).all()


def test_signatures_of_one_pair_are_looked_at_once(spark, monkeypatch):
    """Documents that share a run of words but aren't alike meet once, by their signature's star, and components are those of brute force."""
    from logsignals.llm import op6_jaccard_join as op6

    rng = np.random.default_rng(3)
    base = [[f"w{int(x)}" for x in rng.integers(0, 10**6, 60)] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        for edits in range(3):
            own = list(words)
            for e in range(edits):
                own[5 + 20 * e] = f"e{i}"
            rows.append((3 * i + edits, " ".join(own)))
    rows.append((1000, " ".join(base[0][:30] + base[1][30:])))
    monkeypatch.setattr(op6, "HELD", 200)
    got = {r.doc_id: r.component_id for r in op6.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent and len(set(parent.values())) < len(rows)
    keys = np.arange(4)
    held = op6._rows(keys, keys, np.array([0, 0, 0, 2]), np.array([7, 8]), np.array([True, False, True, False])).column(2).to_pylist()
    assert held == [None, [], None, [7, 8]]
