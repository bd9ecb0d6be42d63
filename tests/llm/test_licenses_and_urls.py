"""License notices against edit distances by dynamic programming, names of other licenses, and hosts without labels."""

import time

import numpy as np
import pytest

from logsignals.llm import op4_license_scans as op4
from logsignals.llm import op10_url_filters as op10


def _least_edits(notice, text):
    """Edits of the closest substring of text, and of the whole text."""
    free, whole = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for row, first in ((free, True), (whole, False)):
        for i, c in enumerate(notice, 1):
            left = row.copy()
            row[0] = i
            for j, d in enumerate(text, 1):
                row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (c != d))
    return int(free.min()), int(whole[-1])


@pytest.fixture(scope="module")
def finder():
    return op4.NoticeFinder(op4.NOTICES)


def test_other_licenses_are_not_taken_for_known_ones(finder):
    for name in ("bsd", "isc", "gpl", "epl", "new", "mpl", "wtf"):
        for lead in ("licensed", "released"):
            assert finder.spans(f"this file is {lead} under the {name} license and so on") == [], name
    for text in ("licensed under cc by nd 4 0", "gnu general public license version 1", "mozilla public license version 1 1", "licensed under the apache license version 1 1", "gnu affero general public license version 4"):
        assert finder.spans(text) == [], text
    assert [s[0] for s in finder.spans("licensed under the bsd license or licensd under the mit license")] == ["mit"]
    assert [s[0] for s in finder.spans("gnu lesser general public license version 3")] == ["lgpl"]


def test_spans_equal_edit_distances(finder):
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    found = missed = 0
    for _ in range(200):
        notice, label = list(op4.NOTICES.items())[int(rng.integers(0, len(op4.NOTICES)))]
        k, own = len(notice) // op4.PER_EDIT, list(notice)
        for _ in range(int(rng.integers(0, k + 3))):
            at = int(rng.integers(0, len(own)))
            own[at : at + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2)))
        planted = " ".join("".join(own).split())
        text = f"zzq yyx {planted} xxq zzy"
        spans = finder.spans(text)
        for name, a, b, edits, _ in spans:
            n = next(n for n, x in op4.NOTICES.items() if x == name and _least_edits(n, text[a:b])[1] == edits)
            assert edits <= len(n) // op4.PER_EDIT and all(w in text[a:b].split(" ") for w in op4.TELLING.get(name, ()) if w in n.split(" "))
        least = _least_edits(notice, text)[0]
        told = all(w in planted.split(" ") for w in op4.TELLING.get(label, ()) if w in notice.split(" "))
        if least <= k and told:
            found += 1
            assert label in {s[0] for s in spans}, (notice, planted)
        elif not told and notice.count(" ") > 1:
            missed += 1
            assert label not in {s[0] for s in spans}, (notice, planted)
    assert found > 80 and missed > 5


def test_many_seeds_without_a_notice_are_quick(finder):
    for text in ("licensed " * 20_000, "licensed under the bsd license " * 5_000):
        began = time.time()
        assert finder.spans(text.strip()) == [] and time.time() - began < 10


def test_hosts_without_labels_are_allowed(spark):
    urls = [f"http://a{i}.com/de/{j}" for i in range(30) for j in range(5)] + [f"http://n{i}.net/x/{j}" for i in range(20) for j in range(3)]
    got = {r.page_id: r for r in op10.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {got[i].verdict for i in range(150)} == {"block"} and {got[i].verdict for i in range(150, len(urls))} == {"allow"}
