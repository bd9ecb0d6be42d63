"""Very long words: no recursion, and time in proportion."""

import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsignals.llm import op1_secret_scans as op1
from logsignals.llm import op2_lm_scoring as op2
from logsignals.llm import op7_token_counts as op7

JOINED = re.compile(r"^(?:[A-Z]?[a-z]+[/_=+-]+)+[A-Za-z]*[0-9]{0,4}$")


def test_joined_words_are_allowed_as_before(spark):
    rng = np.random.default_rng(1)
    strings = ["".join(rng.choice(list("abAB-_/=+12"), int(rng.integers(1, 14)))) for _ in range(3000)] + ["some-long_slug/with=words12", "Ab-", "-ab-", "ab--cd", "ab-12345", "aB-c", ""]
    got = {r.s: r.ok for r in spark.createDataFrame([(s,) for s in strings], "s string").select("s", op1.allowed(F.col("s")).alias("ok")).collect()}
    other = re.compile("|".join(op1.ALLOWED))
    assert all(got[s] == bool(JOINED.search(s) or other.search(s)) for s in strings) and sum(bool(JOINED.search(s)) and not other.search(s) for s in strings) > 5


def test_secrets_in_words_of_a_megabyte(spark):
    rng = np.random.default_rng(2)
    slug, key = "ab-" * 300_000 + "12345", "".join(rng.choice(list(op1.ALPHABET), 1_000_000))
    rows = [(1, slug), (2, key), (3, "see " + slug + " and password=abcdefgh1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in op1.secrets(docs).select("doc_id", op1.joined(F.col("secrets")).alias("s")).collect()}
    at = len("see " + slug + " and ")
    assert got[2].startswith("entropy_b64:0:1000000") and got[3].endswith(f"assign:{at}:{at + 18}")
    clean = {r.doc_id: r.text for r in op1.redacted(docs).collect()}
    assert clean[2] == "[SECRET]" and clean[3].endswith(" and [SECRET]")


ODD = ["it's", "'s", "'S", "'ll", "'l", "'re", "'R", "l", "e", "é", "é", "́", "İ", "Σ", "<|endoftext|>", "<|", "|>", "<", "|", "!", "...", "'", "''", "1", "²", "…", "文", "ſ", "'ſ", "ß", "ﬁ", "A", "Å", "x̧", "don't", "<|startoftext|>", "<|EndOfText|>", "1's", "!'s", "’s", "-", "_"]


def test_prefixes_of_odd_runs_equal_the_library():
    path, rng = public_tokenizers.path(op7.VOCABULARY), np.random.default_rng(3)
    library, counter = Tokenizer.from_file(path), op7.PrefixCounter(path)
    for _ in range(1500):
        run = "".join(rng.choice(ODD, int(rng.integers(1, 9))))
        assert counter.within(run).tolist() == [len(library.encode(run[:k], add_special_tokens=False).ids) for k in range(len(run) + 1)], run


def test_odd_runs_of_any_length(monkeypatch):
    path = public_tokenizers.path(op7.VOCABULARY)
    library, counter = Tokenizer.from_file(path), op7.PrefixCounter(path)
    for run in ("it's" * 25_000, "a'b!c<|" * 15_000, "don't<|endoftext|>" * 6_000):
        began = time.time()
        held = counter.within(run)
        assert len(held) == len(run) + 1 and held[-1] == len(library.encode(run, add_special_tokens=False).ids) and time.time() - began < 20
    monkeypatch.setattr(op7, "TOGETHER", 100)  # a few prefixes at once
    word = "é" * 60
    assert op7.PrefixCounter(path).within(word).tolist() == [len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]


def test_words_are_counted_in_parts_and_sums_by_gate_are_those_of_gates(monkeypatch):
    texts = ["The the cat", None, "", "aÉ CAT\x0bsat " * 3, "on the mat"]
    monkeypatch.setattr(op2, "HELD", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["text"]) for x in (texts[:3], texts[3:])]
    got, parts = Counter(), 0
    for part in op2._counted(iter(batches)):
        parts += 1
        got.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
    assert parts > 1 and got == Counter(w for t in texts for w in (t or "").encode().lower().split())
    gate, values = np.arange(1000) * 7 % op2.GATES, np.arange(1000.0)
    apart = gate * op2.LANES + np.arange(1000) % op2.LANES
    assert (op2._by_gate(apart, values) == np.bincount(gate, values, op2.GATES)).all() and (op2._by_gate(apart) == np.bincount(gate, minlength=op2.GATES)).all()
