"""Small documents with every awkward case: nulls in any column, empty, blank and long texts, copies and near copies,
repeated rows, other scripts; and a column whose name clashes with what the operators make."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ",", ""]) if i % 7 == 6 else "") for i in range(n))


def texts() -> list:
    long = prose(1, 3000)
    shared = prose(2, 60)
    near = prose(3, 400).split(" ")
    near2 = [*near[:200], "changed", *near[201:]]
    return [
        prose(4, 50), prose(5, 120) + " " + shared + " " + prose(6, 40), prose(7, 30) + "  " + shared + "\t" + prose(8, 20), None, "", "   \n\t ", long, long, " ".join(near), " ".join(near2),
        "one", "two words", "ÀÉ ünïcode 日本語 текст 🎉", prose(9, 34), prose(10, 35), prose(10, 35), "the " * 200, prose(11, 10) + "\n" + prose(12, 12) + "\n" + prose(13, 9), prose(14, 10) + "\n" + prose(12, 12) + "\n\n" + prose(13, 9) + "x",
        "UPPER Case\r\nline it's <|endoftext|> 3.14 a..b", " lead", "trail ", "\x00\x01 odd \x7f", "x" * 5000,
    ]


def documents(spark):
    rows = [(i, t, None if i % 5 == 4 else ("en", "fr")[i % 2], None if i % 7 == 3 else f"src{i % 3}", len(t or ""), "own") for i, t in enumerate(texts())]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a null key", None, None, None, "own"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def keyed(spark):
    """The same with distinct keys that aren't null."""
    return documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
