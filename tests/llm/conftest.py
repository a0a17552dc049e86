import random

import pytest

LONG = "word " * 3000


@pytest.fixture(scope="session")
def made():
    """Rows (doc_id, text, lang, source): plain texts, copies, near copies, nulls, empties, a very long text, repeated lines, odd characters."""
    r = random.Random(3)
    syllables = {"en": "the of and ing tion er is to wh".split(), "de": "der und ein sch ung keit zu ü ß".split(), "fr": "le de que eau ment é è ais ou".split()}

    def text(lang, n):
        return " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."

    rows = []
    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, text(lang, r.choice((3, 12, 60, 120))), lang, f"host{i % 4}" if i % 7 else None))
    for i in range(150, 200):  # near copies of the long ones, exact copies, case and space changed
        of = r.randrange(150)
        base = rows[of][1].split(" ")
        if i % 3 and len(base) > 40:
            base[r.randrange(len(base))] = "changed"
        t = " ".join(base)
        rows.append((i, t.upper() if i % 5 == 0 else t, rows[of][2], "host1"))
    odd = [None, "", "   \n\t ", "one", "12345 67", "…—", "A\nA\n\nA\nb", LONG, "naïve café x \U0001f600 end", "x" * 3000, "a b c a b c a b c", "tab\tand\x0bvertical"]
    rows += [(200 + i, t, None if i % 2 else "en", "host2") for i, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, made):
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def texts(made):
    return {i: t for i, t, _, _ in made}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
