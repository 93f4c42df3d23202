import random

import pytest

WORDS = {"en": "the of and to is in that it for was on are as with by river stone market window garden letter".split(),
         "de": "der die das und ist nicht ein eine mit den von zu auf strasse haus fenster garten brief wagen".split(),
         "fr": "le la les et est des un une que qui dans pour pas sur maison fenetre jardin lettre voiture".split()}


def prose(rng, lang, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS[lang])
        if rng.random() < 0.4:
            w = "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 9)))
        out.append(w + ("," if rng.random() < 0.05 else ""))
        if i % 37 == 36:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def doc_rows():
    """(doc_id, text, lang, source): copies, near copies, shared lines, nulls, odd white space, one long text."""
    rng = random.Random(7)
    rows = []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        rows.append([i, prose(rng, lang, rng.randint(5, 300)), lang, f"s{i % 5}" if i % 3 else "s0"])
    passage = prose(rng, "en", 60).replace("\n", " ")
    for i in (3, 20, 41):
        rows[i][1] += "\n" + passage + "\nend"
    rows[50][1] += "\n" + passage.replace("the", "tha", 1) + "\nend"
    for a, b in ((10, 60), (10, 61), (11, 62)):
        rows[b][1] = rows[a][1]
    rows[12][1] = prose(rng, "en", 400)
    rows[63][1] = rows[12][1] + " more"
    rows += [[100, None, "en", None], [101, "", None, "s1"], [102, " \t\n\x0b ", "xx", "s2"], [103, "one two", None, None],
             [104, "Ünï ÇÖDE\r\n日本語 text <|endoftext|> it's 12 345 x", "en", "s0"],
             [105, "x" * 3000, "en", "s0"], [106, "spam! " * 700, "en", "s0"], [107, prose(rng, "fr", 6000), "fr", "s0"],
             [None, "no id at all " * 30, "en", "s0"], [108, "twice twice", "en", "s1"], [108, "twice twice", "en", "s1"]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def doc_dir(spark, doc_rows, tmp_path_factory):
    """A folder like those of the driver, with clashing extra columns."""
    out = str(tmp_path_factory.mktemp("docs"))
    rows = [(*r, len(r[1] or ""), 1, "x") for r in doc_rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"
                          ).repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="session")
def empty_dir(spark, doc_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("none"))
    spark.read.parquet(f"{doc_dir}/documents.parquet").limit(0).write.parquet(f"{out}/documents.parquet")
    return out
