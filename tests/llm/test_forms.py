import re
import unicodedata

from claimloom.llm import forms

SAME = [
    ("caf\xe9", "cafe\u0301"), ("\uff21\uff22\uff11", "AB1"), ("file", "\ufb01le"), ("a b", "a\xa0b"), ("a b", "a\u3000b"), ("a b", "a\u2009b"),
    ("a b", "a\u202fb"), ("well-known", "well\u2010known"), ("a\u2011b", "a-b"), ("zero\u200bwidth\ufeff", "zerowidth"), ("soft\xadhyphen", "softhyphen"), ("\u0440\u0430\u0441\u0435", "pace"),
    ("\u0397\u0391\u03a4", "HAT"), ("\xb5m", "\u03bcm"), ("\u212a", "K"), ("a\xb7b", "a\u0387b"), ("\u0435\u0308", "\u0451"), ("\u0451", "\xeb"),
    ("a\r\nb", "a\nb"), ("\u2f54", "\u6c34"), ("\uf97e", "\u91cf"), ("\U0001d44e\U0001d44f\U0001d455", "abh"), ("\ufb03", "ffi"), ("", ""),
    ("e\u200b\u0301", "\xe9"), ("\u212b", "A\u030a"),
    ("\u33a1", "m²"), ("\u33a5", "m³"), ("\u2103", "°C"), ("\u2167", "VIII"), ("\ua4ee\u13aa\u054f", "AAS"), ("\U0001d6dd", "ϑ"),
]
DIFFERENT = [("a b", "a  b"), ("a b", "a\nb"), ("a b", "a\tb"), ("A", "a"), ("a.", "a"), ("m²", "m2"), ("e", "é"), ("½", "1/2"), ("a–b", "a-b"), ("a,b", "a.b"), ("\u33a1", "m2"), ("\u017f", "s"), ("ϖ", "π"), ("ϑ", "θ"), ("…", "..."), ("⑴", "(1)"), ("‼", "!!"), ("´", " \u0301")]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return {int(r.id): r.form for r in forms.visual_forms(df, ["id"], "t").collect()}


def test_pairs(spark):
    flat = [t for p in SAME + DIFFERENT for t in p]
    got = run(spark, flat)
    for n, (a, b) in enumerate(SAME + DIFFERENT):
        assert (got[2 * n] == got[2 * n + 1]) == (n < len(SAME)), (a, b, got[2 * n], got[2 * n + 1])
    again = run(spark, [got[i] for i in range(len(flat))])
    assert again == got  # a form is its own form


def test_unusual_input(spark):
    long = "ａ" * 200_000 + "'\\"
    got = run(spark, [None, "", long, "plain ascii"])
    assert got == {0: None, 1: "", 2: "a" * 200_000 + "'\\", 3: "plain ascii"}
    assert run(spark, []) == {}


def test_mapping_keeps_letters():
    for c, to in forms.mapping().items():
        assert unicodedata.normalize("NFC", c) != to and not unicodedata.decomposition(c).startswith(forms.DIFFERENT)


def test_found_pairs(spark):
    rows = [("1", "a b"), ("2", "a\u00a0b"), ("2", "a\u00a0b"), ("3", "a b"), ("4", "a\u2009b"), ("5", "x"), ("6", "x"), ("7", None), ("8", None), ("9", "")]
    df = spark.createDataFrame([("t", *r, 1) for r in rows] + [("u", "1", "a\u00a0b", 1)], "table_name string, record_id string, text string, form_key int")
    classes = forms.look_alike_classes(forms.form_keys(df, ["table_name", "record_id"], "text"))
    got = {tuple(r) for r in forms.look_alike_pairs(classes).collect()}
    assert got == {("t", a, b) for a, b in [("1", "2"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")]}


def test_every_mapped_character_in_one_batch(spark):
    table = forms.mapping()
    assert sum(len(to) > 1 for to in table.values()) > 10 * forms.STEP
    unseen = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", forms.INVISIBLE))
    every = sorted(table)
    got = run(spark, every)
    assert [got[i] for i in range(len(every))] == [unicodedata.normalize("NFC", unseen.sub("", table[c])) for c in every]


def test_letters_keep_their_case():
    for xs, ys in forms.LOOK_ALIKES:
        assert len(xs) == len(ys) and all(unicodedata.category(x) in (unicodedata.category(y), "Lo") for x, y in zip(xs, ys))
