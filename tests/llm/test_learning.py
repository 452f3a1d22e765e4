"""What op5 learns, against its definition in plain loops; how many links op2 finds among large sets."""

import math
import random
from collections import Counter

import numpy as np

from quarrylens.llm import op2_jaccard_join, op5_toxicity


def learned(rows):
    """Lexicon and learned exceptions of (text, label) rows, by the definition."""
    folded = [(op5_toxicity.fold(t), y) for t, y in rows]
    terms = [({f" {w} " for w in f.split()} | {f" {w[:k]}" for w in f.split() for k in range(4, 10) if len(w) >= k}, y) for f, y in folded]
    n = Counter(y for _, y in rows)
    count = [Counter(t for s, y in terms if y == k for t in s) for k in (0, 1)]
    base = n[1] / (n[0] + n[1])
    frequent = [t for t, c in count[1].items() if c >= op5_toxicity.MIN_DOCS]
    strong = {}
    for t in frequent:
        bad, good = count[1][t], count[0][t]
        odds = math.log((bad + 0.5) / (n[1] + 1)) - math.log((good + 0.5) / (n[0] + 1))
        both = bad + good
        ratio = 2 * sum(k * math.log(k / both / share) for k, share in ((bad, base), (good, 1 - base)) if k)
        if odds >= op5_toxicity.MIN_ODDS and ratio >= 2 * math.log(max(2, len(frequent))):
            strong[t] = odds
    lexicon = {}
    for t in sorted(strong, key=lambda t: (-count[1][t] * strong[t], len(t), t)):
        if not any(t.startswith(s) and 5 <= len(s) < len(t) and count[1][s] >= count[1][t] and lexicon[s] >= strong[t] - 0.7 for s in lexicon):
            lexicon[t] = strong[t]
    phrases = Counter()
    for f, y in folded:
        words = f.split()
        own = set()
        for k, w in enumerate(words):
            if any(f" {w} ".startswith(t) for t in lexicon):
                own |= {f"{w} {x}" for x in words[k + 1 : k + 2]} | {f"{x} {w}" for x in words[max(0, k - 1) : k]}
        phrases.update((p, y) for p in own)
    exceptions = {p for p, y in phrases if y == 0 and phrases[p, 0] >= 5 and not phrases[p, 1]}
    return lexicon, exceptions


def test_lexicon_exceptions_and_curve(spark):
    rng = random.Random(8)
    calm = ["river", "stone", "green", "walks", "house", "paper", "light", "water", "apple", "music"]
    rows = []
    for k in range(160):
        words = [rng.choice(calm) for _ in range(rng.randrange(4, 20))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbledorf", "Gr0mblix", "snortface", "snortfaces"]))
        elif k % 5 == 1:
            words += ["snortface", "cake"]
        rows.append((" ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = op5_toxicity.fit(docs, labels)
    lexicon, exceptions = learned(rows)
    assert lexicon and model["lexicon"].keys() == lexicon.keys()
    assert all(abs(model["lexicon"][t] - w) < 1e-12 for t, w in lexicon.items())
    assert model["exceptions"] - {op5_toxicity.fold(x).strip() for x in op5_toxicity.EXCEPTIONS} == exceptions
    # at its best the curve's penalised likelihood has no slope
    a = op5_toxicity.automaton(model["lexicon"], model["exceptions"])
    got = np.array([op5_toxicity.weigh(op5_toxicity.fold(t), a) for t, _ in rows], float)
    x, y = op5_toxicity.traits(got[:, 0], got[:, 1]), np.array([y for _, y in rows], float)
    p = 1 / (1 + np.exp(-(x @ model["curve"])))
    assert np.abs(x.T @ (y - p) - 1e-2 * np.array([0, 1, 1]) * model["curve"]).max() < 1e-3


def test_links_among_sets_above_the_exact_size(spark):
    """Pairs at and just above the threshold, of sets of 65 to 600 shingles: all links are found."""
    rng = random.Random(9)
    rows, want, tight = [], {}, 0
    for k in range(250):
        size = rng.choice([70, 90, 130, 200, 330, 600])
        words = [f"w{k}x{i}" for i in range(size)]
        other = list(words)
        edge = words
        # change words until one more would part the two
        for i in rng.sample(range(size), size):
            other[i] = "y" + other[i]
            a, b = ({tuple(x[j : j + 5]) for j in range(size - 4)} for x in (words, other))
            if 100 * len(a & b) < 75 * len(a | b):
                break
            edge = list(other)
        a, b = ({tuple(x[j : j + 5]) for j in range(size - 4)} for x in (words, edge))
        tight += 100 * len(a & b) < 82 * len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edge)), (1000 + k, " ".join(other))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in op2_jaccard_join.join(df).collect()}
    found = sum(got[i] == c for i, c in want.items() if i % 2)
    assert tight > 150 and found == 250
