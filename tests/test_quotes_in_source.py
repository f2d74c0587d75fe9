"""The join on rare inner words finds what trying every section finds."""

import random

from claimloom.operators import quotes


def test_against_all_sections(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(20)] + [f"溶解{i}" for i in range(5)] + ["水与", "的，"]
    sections = [(f"S{s}", f"X{s}-{n}", n, "  ".join(rng.choice(vocabulary) for _ in range(40))) for s in range(3) for n in range(8)]
    claims = []
    for i in range(60):
        s = f"S{i % 3}"
        words = rng.choice([x for x in sections if x[0] == s])[3].split()
        a = rng.randrange(30)
        claims.append((f"C{i}", s, rng.choice([" ", "  "]).join(words[a : a + rng.randint(1, 6)])))
    claims += [("N", "S1", "nowhere to be found"), ("0", "S1", None), ("1", None, "w1 w2"), ("2", "S2", "")]
    got = {r.claim_id: (r.section_id, r.status) for r in quotes.in_source(spark.createDataFrame(claims, "claim_id string, source_id string, source_quote string"), spark.createDataFrame(sections, "source_id string, section_id string, sequence_number int, text string")).collect()}
    want = {}
    for c, s, q in claims:
        if not q or not s:
            continue
        exact = [x[1] for x in sections if x[0] == s and q in x[3]]
        loose = [x[1] for x in sections if x[0] == s and " ".join(q.split()) in " ".join(x[3].split())]
        if exact or loose:
            want[c] = (exact[0], "exact") if exact else (loose[0], "normalised")
    assert got == want
