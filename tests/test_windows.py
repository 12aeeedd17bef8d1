"""Citing windows and annotated contexts against a plain version, and the joins' odd cases."""

import re

from veriscope.operators import adjudicate, discovery, harvest, runs

TEXTS = [
    ("One is here. Two (Lee et al. 2010) is there. Three follows now. Four ends it all.", "(Lee et al. 2010)", None),
    ("Short.", "x", "y"),
    ("No marks at all but rather many words " * 9, "words", None),
    ("A first one. " * 12 + "The cited [3] one. " + "A last one! " * 12, "[3]", "nothing"),
    ("Alpha beta, 2001 said so. Gamma [4] did not. Delta [4] did. An unmarked rest that is long", "[4]", "beta, 2001"),
    ("Alpha beta, 2001 said so. Gamma [4] did not. Delta [4] did.", "[4]", "absent"),
    ("All [1] here. All [1] there.", "[1]", None),
    ("x" * 150 + ". " + "y" * 150 + ". " + "z" * 10 + ".", "zz", None),
    ("One. Two [7] ", "[7] ;", None),
    ("", "m", None),
]


def spans(text):
    out = [(m.group(), m.start()) for m in re.finditer(r"[^.!?]*[.!?]+", text)]
    rest = text[out[-1][1] + len(out[-1][0]) if out else 0 :]
    return out + ([(rest, len(text) - len(rest))] if len(rest.strip()) > 20 else [])


def tidy(marker):
    return re.sub("[,;:]+$", "", re.sub(r"\s+", " ", marker)).strip()


def position(text, marker):
    for x in (marker, tidy(marker), (re.search(r"\w+\s+et\s+al\.?,?\s*\d{4}", tidy(marker)) or [""])[0]):
        if x and x in text:
            return text.index(x)
    return len(text) // 2


def window(text, marker, most):
    if len(text) <= most:
        return text
    s, at = spans(text), position(text, marker)
    if len(s) > 1:
        lo = hi = min(range(len(s)), key=lambda k: (max(s[k][1] - at, at - s[k][1] - len(s[k][0]), 0), k))
        n = len(s[lo][0])
        grew = True
        while grew:
            grew = False
            if lo and n + len(s[lo - 1][0]) <= most:
                lo, n, grew = lo - 1, n + len(s[lo - 1][0]), True
            if hi + 1 < len(s) and n + len(s[hi + 1][0]) <= most:
                hi, n, grew = hi + 1, n + len(s[hi + 1][0]), True
        if found := "".join(x for x, _ in s[lo : hi + 1]).strip():
            return found
    return text[max(0, at - most // 2) :][:most].strip()


def annotated(text, marker, label):
    s = [x for x, _ in spans(text)]
    first = label or marker
    marks = [first in x for x in s]
    if not any(marks):
        marks = [tidy(first) in x or bool(label) and marker in x for x in s]
    if len(s) < 2 or not any(marks) or all(marks):
        return text
    out, on = "", False
    for x, m in zip(s, marks):
        out = out + "<< " + x if m and not on else out.rstrip() + " >> " + x if on and not m else out + x
        on = m
    return out.rstrip() + " >>" if on else out


def test_windows_and_annotations(spark):
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(TEXTS)], "k int, context string, marker string, label string")
    for most in (30, 60, 200):
        for r in harvest.citing_window(df, "context", "marker", "w", most).collect():
            assert r["w"] == window(r["context"], r["marker"], most), (most, r)
    for r in harvest.annotate_context(df, "context", "marker", "label", "a").collect():
        assert r["a"] == annotated(r["context"], r["marker"], r["label"]), r


def test_fail_open_and_unknown(spark):
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id int")
    answers = spark.createDataFrame([(1, False), (2, None)], "paper_id int, relevant boolean")
    assert sorted(r[0] for r in discovery.keep_relevant(papers, answers).collect()) == [2, 3]
    assert adjudicate.with_rubric(spark.createDataFrame([("other",)], "mode string")).first()["options"] is None
    empty = spark.createDataFrame([], "run_id int, updated int, status string")
    assert runs.active_run(empty).count() == 0
