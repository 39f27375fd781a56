import random
import re

from tests.llm.helpers import PROSE, clash, docs
from tidemark.llm import licenses as L
from tidemark.llm.license_texts import TEMPLATES


def words(t):
    return re.sub(r"[^\w]+|_", " ", t.lower()).split()


def grams(t):
    w = words(t)
    return set(zip(w, w[1:]))


def slow(rows):
    out = {}
    for d, t in rows:
        for u in {" ".join(words(x)) for x in [*(t or "").split("\n"), *re.split(r"\n *\n", t or ""), t or ""]}:
            for name, body in TEMPLATES.items():
                a, b = grams(u), grams(body)
                if a and (dice := 2 * len(a & b) / (len(a) + len(b))) >= L.LEAST_DICE:
                    best, n = out.get((d, name), (0, 0))
                    out[d, name] = max(best, dice), n + 1
    return out


def test_scan_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "License"), (4, " ".join(PROSE) * 2000)]
    for i, (name, body) in enumerate(TEMPLATES.items()):
        rows.append((100 + i, f"{' '.join(PROSE)}\n{body}\nmore"))
        rows.append((200 + i, f"intro\n\n{body.replace(' ', chr(10), 3)}\n \nend"))
        w = body.split()
        for k in (1, 2, 4):
            changed = list(w)
            for j in rnd.sample(range(len(w)), min(k, len(w))):
                changed[j] = rnd.choice(["foo", "bar baz", ""])
            rows.append((300 + 10 * i + k, " ".join(changed).upper()))
    rows += [(None, "Released under the MIT License."), (7, "Released under the MIT License.\nReleased under the MIT license!"), (8, TEMPLATES["MIT"]), (8, TEMPLATES["MPL-2.0"])]
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in L.scan(clash(docs(spark, rows), "id", "norm", "license", "unit", "t")).collect()}
    assert got == slow(rows) and len(got) > 3 * len(TEMPLATES)


def test_empty_table_and_no_templates(spark):
    assert L.scan(docs(spark, [])).count() == 0
    assert L.scan(docs(spark, [(1, "MIT")]), templates={"one": "word"}).count() == 0


def test_plan_has_no_python(spark):
    plan = L.scan(docs(spark, [(1, "MIT License")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
