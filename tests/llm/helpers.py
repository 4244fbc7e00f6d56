"""Small fixtures that every operator of the subpackage meets: nulls, empty and long texts, ties, repeats, clashing columns."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A Line That Several of the Documents hold."


def texts() -> list:
    long = " ".join(f"word{i % 977} of the {i % 13} tale" for i in range(6000))
    near = " ".join(f"w{i}" for i in range(200))
    return [
        (1, None), (2, ""), (3, "one"), (4, "two words"), (5, "three little words"), (5, "three little words"),
        (6, long), (7, long), (8, long + " end"), (9, near), (10, near.replace("w77 ", "x77 ")), (11, near.replace("w5 ", "x5 y5 ")),
        (12, f"{LINE}\nalpha\n"), (13, f"  {LINE.upper()}\t\nbeta"), (14, f"gamma\n{LINE}"), (15, f"{LINE}\n{LINE}\nshort"),
        (16, "# * $ | symbols <> & %\nagain\nagain\n\nagain"), (17, "ÄÖ Σίσυφος naïve ½ 中文字 don't we'll <|endoftext|> <|ENDOFTEXT|> x"),
        (18, "the end the end the end the end"), (19, "\n\n \t\n"), (None, "no id at all but a text"), (20, "a" * 5000), (21, "a" * 5000),
    ]


def documents(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, None if i == 3 else f"src{(i or 0) % 3}", len(t or "")) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA)


def write(d, path, name="documents"):
    d.coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def words(text):
    return WORD.findall((text or "").translate(FOLD))
