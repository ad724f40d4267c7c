import re

from fixtures import frame, texts, words

from tessera.llm import license_scan


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    notice = license_scan.NOTICES[3][0].split()
    extra = [
        "Released under the MIT License. cc BY-NC CC by nc", "Apache License, Version 2.0", "under the\nmit-license!", "under the mit", "CC BY NC 4.0 under the MIT license é under_the mit license",
        "x " * 50 + "Licensed under the Apache License, Version 2.0. " * 30, "under the mit license" * 3,
        " ".join([*words(rng, 40), *notice, *words(rng, 9)]), " ".join([*notice[:12], "and", "then", *notice[12:20], *notice[21:]]), " ".join(notice[:6]),
    ]
    rows = list(enumerate([*texts(), *extra])) + [(3, "cc by nc"), (3, "cc by nc"), (None, "cc by nc")]
    got = license_scan.license_labels(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    by = {r.doc_id: r for r in got}
    at = len(texts())
    assert by[at + 7].labels == "mit" and by[at + 7].score == 1.0 and by[at + 7].base_labels == ""
    assert by[at + 8].labels == "mit" and 0.6 <= by[at + 8].score < 1
    assert by[at + 9].labels == "" and 0 < by[at + 9].score < 0.6
    assert by[0].labels == "" and by[0].score == 0.0
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert license_scan.license_labels(frame(spark, [])).collect() == []


def test_notices_are_verified_by_their_words(spark):
    """Competing templates, other versions and qualifiers, and real notices within runs of stray votes."""
    gpl3, gpl2, cc, sa, bsd = (license_scan.NOTICES[i][0] for i in (0, 1, 8, 9, 4))
    stray = " ".join(f"{w} this work is licensed" for w in "abcdefghijklmnop")
    rows = [
        (gpl3, "gpl-3"), (gpl2, "gpl-2"), (cc, "cc-by"), (sa, "cc-by-sa"), (f"{gpl2}. {gpl3}", "gpl-2,gpl-3"), (gpl3.replace("version 3", "version 4"), ""),
        (cc.replace("attribution", "attribution noncommercial"), ""), (gpl3.replace("general", "lesser general"), ""), (f"{stray} {gpl3} {stray}", "gpl-3"),
        (" ".join(reversed(bsd.split())), ""), (cc.replace("4 0", "3 0"), "cc-by"), (f"{bsd} {bsd} {cc}", "bsd,cc-by"),
    ]
    got = license_scan.license_labels(frame(spark, [(i, t, "s") for i, (t, _) in enumerate(rows)])).collect()
    assert {r.doc_id: r.labels for r in got} == {i: x for i, (_, x) in enumerate(rows)}
