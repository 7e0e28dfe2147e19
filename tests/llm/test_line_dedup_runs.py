"""Repeated runs go as a whole."""

import random
import re

from evgraph.llm.line_dedup import CUT, NOISE_WORDS, SURE_WORDS, dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line(name, words):
    return " ".join(f"{name}{k}" for k in range(words))


def texts(spark, docs):
    return {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_whole_runs_go(spark):
    docs, want = [], {}
    for lines in ([line(f"a{k}x", 45) for k in range(3)], [line(f"b{k}x", 10) for k in range(6)], [line(f"c{k}x", 10) for k in range(15)]):
        p, d = "\n".join(lines), len(docs)
        docs.append((d, f"head\n{p}\nmiddle\n{p}\ntail\n{p}\nend"))
        want[d] = f"head\n{p}\nmiddle\ntail\nend"
    for k in range(3):  # holders of one line hide no run, whichever line is the least
        lines, d = [line(f"d{k}y{j}x", 45) for j in range(3)], len(docs)
        p, part = "\n".join(lines), lines[k]
        docs += [(d, f"zero\n{part}\nz"), (d + 1, f"one\n{p}\no"), (d + 2, f"two\n{part}\nt"), (d + 3, f"three\n{p}\nth"), (d + 4, f"four\n{p}\nf")]
        want |= {d: docs[d][1], d + 3: "three\nth", d + 4: "four\nf"}
    got = texts(spark, docs)
    assert {d: got[d] for d in want} == want


def segments(text):
    return [(x.strip(" \t\n\x0b\f\r"), len(WORD.findall(x)), x) for x in re.split(CUT, text)]


def slow(docs):
    """What has to stay of each text: windows of SURE_WORDS (from a line on, or up to a line) that occurred before are laid beside the first document
    that holds them, or the place before in their own document, and runs of NOISE_WORDS or more that are equal there go."""
    parts = {d: segments(t) for d, t in docs}

    def windows(p):
        out = set()
        for i in range(len(p)):
            for step in (1, -1):
                words, j = 0, i
                while 0 <= j < len(p) and words < SURE_WORDS:
                    words += p[j][1]
                    j += step
                if words >= SURE_WORDS:
                    out.add((i, j) if step == 1 else (j + 1, i + 1))
        return sorted(out)

    first, gone = {}, {d: set() for d, _ in docs}
    for d, _ in sorted(docs):
        before = {}
        for i, j in windows(parts[d]):
            key = tuple(x for x, _, _ in parts[d][i:j])
            met = [(d, before[key])] if key in before else [first[key]] if key in first else []
            before[key] = i
            for d0, i0 in met:
                shift, p, p0 = i - i0, parts[d], parts[d0]
                run, words = [], 0
                for k in [*range(max(0, shift), min(len(p), len(p0) + shift)), None]:
                    if k is not None and p[k][0] == p0[k - shift][0]:
                        run.append(k)
                        words += p[k][1]
                        continue
                    if words >= NOISE_WORDS:
                        gone[d].update(run)
                    run, words = [], 0
        for key, i in reversed(before.items()):
            first.setdefault(key, (d, min(k for k, j in windows(parts[d]) if tuple(x for x, _, _ in parts[d][k:j]) == key)))
    return {d: "\n".join(x for k, (_, _, x) in enumerate(parts[d]) if k not in gone[d]) if gone[d] else t for d, t in docs}


def test_against_brute_force(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [[fresh(rng.randint(4, 30)) for _ in range(rng.randint(3, 9))] for _ in range(5)]
    docs = []
    for d in range(50):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [fresh(rng.randint(1, 9)), *p[a : a + rng.randint(1, len(p))]]
        docs.append((d, "\n".join([*parts, fresh(3)])))
    got = texts(spark, docs)
    want = slow(docs)
    assert sum(want[d] != t for d, t in docs) > 10
    assert [d for d, _ in docs if got[d] != want[d]] == []


def test_the_examples_of_runs_twice_in_a_text(spark):
    docs = [(d, "\n".join([line(f"d{d}r{k}x", words) for k in range(n)] * 2)) for d, (n, words) in enumerate(((10, 10), (9, 12), (12, 8)))]
    got = texts(spark, docs)
    assert all(got[d] == t[: len(t) // 2] for d, t in docs)
