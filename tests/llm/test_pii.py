import random
import re

from tests.llm.helpers import clash, docs
from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_follow_the_patterns():
    rnd = random.Random(2)
    parts = [*"ab@.+-% 019()", "4111 1111 1111 1111", "4111111111111111", "a@b.c", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "\n", "é", "٣"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        assert pii.base_spans(text) == slow(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1.1" * 100_000, "+1(" * 100_000, "+1" + "(" * 300_000, "one " * 50_000, "one two " + "1 " * 100_000, "x [at] y " + "a" * 300_000, "1." * 150_000, "a" * 300_000 + " [at] b"):
        pii.all_spans(text)


def added(text):
    base, every = pii.all_spans(text)
    assert set(base) <= set(every)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]


def test_disguises_map_back_to_the_source():
    assert added("mail john [at] example [dot] com now") == [("email", "john [at] example [dot] com")]
    assert added("write to j.doe at mail dot example dot org.") == [("email", "j.doe at mail dot example dot org")]
    assert added("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ") == [("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]
    assert added("see jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")] or added("see jоhn@exаmple.com") == []
    assert added("call plus one five five five one two three four five six seven!") == [("phone", "plus one five five five one two three four five six seven")]
    assert added("card four " + "one " * 15 + "x") == [("card", ("four " + "one " * 15).strip())]
    assert added("１９２.１６８.0.1") == [("ip", "１９２.１６８.0.1")]


def test_disguised_dots_and_digit_names_at_any_boundary():
    for text in ("john at example [dot] com", "john at example(dot)com", "john at example (punkt) de", "john@example[dot]com", "john@example dot com", "j@mail.example (dot) org"):
        tape = pii.deobfuscate(text)
        assert ("email", text) in [(pii.KINDS[k], text[slice(*tape.source(a, b))]) for a, k, b in pii.base_spans(tape.text)]
    assert added("x john@example[dot]com y") == [("email", "john@example[dot]com")]
    assert added("(plus 1 415 555 01 nine)") == [("phone", "plus 1 415 555 01 nine")]
    assert added("call plus 1 415 555 0199") == [("phone", "plus 1 415 555 0199")]
    assert added("(four 111 1111 1111 1111)") == [("card", "four 111 1111 1111 1111")]
    assert added("a@b.c dotted, c@d.e [1]") == []


def test_pre_tests_agree_with_their_patterns():
    rnd = random.Random(7)
    parts = ["one", "Six", "ſeven", "nıne", "oh", "plus", "PLUS", "at", "dot", "Punkt", "point", "john", "ex", "com", "1", "555", *"[](){}<>@.,-  \n_/'", "é", "ſ", "İ", "\u212a"]
    numbers = disguises = 0
    for _ in range(60_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 14)))
        if rnd.random() < 0.3:
            dots = [".", " dot ", "[dot]", "(.)", " {Punkt} ", "<poınt>", " . "]
            text += rnd.choice(" (") + "jo" + rnd.choice([" at ", "@", "[at]", " ( @ ) ", "at"]) + "ex" + rnd.choice(dots) + "co" + rnd.choice(dots) + rnd.choice(["uk", ""])
        low = pii._lower(text)
        if any(any(c.isalpha() for c in m.group()) for m in pii._NUMBER.finditer(text)):
            numbers += 1
            assert pii.may_number(low), text
        for m in pii._DISGUISE.finditer(text):
            if m.group("at").strip().lower() != "at" or any(d.group() != "." for d in pii._DOT.finditer(m.group("rest"))):
                disguises += 1
                assert pii.may_disguise(text, low), text
    assert numbers > 500 and disguises > 50
    assert pii.deobfuscate("ſix nıne").text == "69"


def test_wider_added_spans_stay_beside_base_spans():
    assert pii.all_spans("jоhn@example.com") == ([(2, 0, 16)], [(0, 0, 16), (2, 0, 16)])  # a Cyrillic o
    assert added("see jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert pii.redact("see jоhn@example.com, jоe@exаmple.com") == "see [EMAIL], [EMAIL]"
    assert added("john@mail.example dot com") == [("email", "john@mail.example dot com")] and pii.redact("john@mail.example dot com") == "[EMAIL]"
    assert added("a@b.c é and x@y.z sаid") == []  # the base spans themselves are not added again
    assert pii.merged([(0, 0, 4), (2, 1, 3), (3, 2, 9), (9, 3, 12)]) == [(0, 0, 9), (9, 3, 12)]


def test_prose_and_base_are_left_alone():
    for text in ("look at example.com today", "one or two of them", "meet me at noon dot", "plain text", "a@b.c and +1 (555) 123-4567"):
        assert added(text) == []
    assert pii.redact("a@b.c, 1.2.3.4 and x (at) y (dot) z") == "[EMAIL], [IP] and [EMAIL]"
    assert pii.redact(None) is None and pii.redact("") == ""


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "1.2.3.4 é 1.2.3.5"), (2, None), (3, ""), (2**62 + 1, "x" * 100_000)]
    got = pii.personal_data(clash(docs(spark, rows), "id", "spans", "n_email", "base")).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.spans, r.n_email, r.n_ip) for r in got), key=key) == sorted(
        [(1, "email:0:5", 1, 0), (1, "email:0:5", 1, 0), (None, "ip:0:7,ip:10:17", 0, 2), (2, "", 0, 0), (3, "", 0, 0), (2**62 + 1, "", 0, 0)], key=key)
    assert pii.personal_data(docs(spark, [])).count() == 0
