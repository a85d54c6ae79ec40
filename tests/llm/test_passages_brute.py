"""Passages against plain Python that tries every range: links, classes, copies and spans, on texts of a few dozen words."""

import random
from collections import Counter

import pytest
from tessella.llm import passages

LEAST = 46  # shingles of 50 words


def shingles(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def ranges(x, y, strict):
    """Ranges [i, j] of x, at least LEAST long, with the range of y that their common shingles span: Jaccard similarity 0.8, enough in common.

    Strict ones begin and end on common shingles: these are to be found. A text of under 50 words has none.
    """
    place = {s: i for i, s in enumerate(y)}
    out = []
    for i in range(len(x)) if min(len(x), len(y)) >= LEAST else ():
        common = set()
        for j in range(i, len(x)):
            if x[j] in place:
                common.add(x[j])
            if (not strict or x[i] in place and x[j] in place) and j - i + 1 >= LEAST and len(common) >= 0.8 * LEAST:
                at = [place[s] for s in common]
                a, b = set(x[i : j + 1]), set(y[min(at) : max(at) + 1])
                if 10 * len(a & b) >= 8 * len(a | b):
                    out.append((i, j, min(at), max(at)))
    return out


def texts(seed):
    """Families of texts around passages of 50 to 70 words with up to four words edited, some too short or too far edited, copies and strangers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(8):
        core = [word() for _ in range(rng.randrange(46, 71))]
        for edits in (0, rng.randrange(5), rng.randrange(5)):
            own = list(core)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join([word() for _ in range(rng.randrange(12))] + own + [word() for _ in range(rng.randrange(12))]))
    out += [out[0], out[0].upper(), out[4]] + [" ".join(word() for _ in range(60)) for _ in range(5)]
    rng.shuffle(out)
    return out


def solved(made, strict):
    """Least member of each text's class, and the words that its ranges cover."""
    sh, group, spans = [shingles(t) for t in made], list(range(len(made))), {i: set() for i in range(len(made))}
    for i in range(len(made)):
        for j in range(len(made)):
            same = i != j and made[i].lower() == made[j].lower()
            found = [] if i == j or same else ranges(sh[i], sh[j], strict)
            if same:
                spans[i] |= set(range(len(made[i].split())))
            for a, b, c, d in found:
                spans[i] |= set(range(a, b + 5))
                spans[j] |= set(range(c, d + 5))
            if same or found:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group, spans


@pytest.mark.parametrize("seed", [1, 2, 3, 5, 8])
def test_every_range_tried(spark, seed):
    """Classes lie between those of strict ranges and those of all; so do the words that are told."""
    made = texts(seed)
    got = {r.doc_id: r for r in passages.result(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)).collect()}
    (least, inner), (most, outer) = solved(made, True), solved(made, False)
    size = lambda group: Counter(group)
    assert {i for i, g in enumerate(least) if size(least)[g] > 1} <= set(got) <= {i for i, g in enumerate(most) if size(most)[g] > 1}
    classes = {i: got[i].class_id for i in got}
    for i in got:
        for j in got:
            assert classes[i] == classes[j] or least[i] != least[j], (i, j)
            assert classes[i] != classes[j] or most[i] == most[j], (i, j)
    for i, r in got.items():
        members = [j for j in got if classes[j] == classes[i]]
        assert r.class_id == min(members) and r.n_copies == sum(t.lower() == made[i].lower() for t in made)
        assert r.n_links == len({made[j].lower() for j in members}) - 1
        covered = {k for s in r.spans.split(",") for k in range(*map(int, s.split(":")))}
        assert covered <= outer[i], i
        # spans come from compared pairs: of two texts they are all there is
        if r.n_links == 1 and r.n_copies == 1:
            assert inner[i] <= covered, i
