import re

from helpers import documents, rows
from pyspark.sql import functions as F

from tracewright.llm import pii


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


TEXTS = [
    None,
    "",
    "no data at all, 12.5 or 1999-2000",
    "Write to ann.lee@mail.example.org or ANN.LEE@MAIL.EXAMPLE.ORG; bob@mail.example.org!",
    "Call +1 (672) 555-0196 or +1 672-555-0196, not +49 (672) 555-0196. 06 12 34 56 78",
    "Card 4111111111111111 and 4111 1111 1111 1111, then 4111111111111112 at 10.1.2.3, twice 10.1.2.3.",
    "Frau Anna Schmidt met Mr. John Smith, Mrs Jane Smith and г-н Иван Петров; SSN 123-45-6789, DE89 3704 0044 0532 0130 00",
    "Card 4111111111111111",
]


def replaced(spark, key="k"):
    docs = documents(spark, TEXTS).withColumn("n_entities", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("_parts", F.lit(2))
    return {r.doc_id: r for r in pii.replace_entities(docs.unionByName(docs), key).collect()}


def test_types_formats_and_coreference(spark):
    got = replaced(spark)
    assert got[0].text is None and got[0].n_entities == 0
    assert got[1].text == "" and got[2].text == TEXTS[2] and got[2].n_entities == 0 and got[2].kind == 1
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    for i in (3, 4, 7):
        assert got[i].text != TEXTS[i] and shape(got[i].text) == shape(TEXTS[i])
    first, again, other = re.findall(r"[\w.]+@[\w.]+\w", got[3].text)
    assert first.upper() == again and first.split("@")[1] == other.split("@")[1] and first.split("@")[0] != other.split("@")[0]
    assert got[3].text.startswith("Write to ") and got[3].n_entities == 3
    phones = re.findall(r"\+(\d+) ([^,. ]+(?: \d\S+)?)", got[4].text)
    numbers = [re.sub(r"\D", "", b) for _, b in phones]
    assert [c for c, _ in phones] == ["1", "1", "49"] and numbers[0][:10] == numbers[1][:10] != numbers[2][:10]
    cards = re.findall(r"4[\d ]{15,18}", got[5].text)
    assert luhn(cards[0]) and re.sub(" ", "", cards[1]) == cards[0].strip() and not luhn(cards[2])
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", got[5].text)
    assert len(set(ips)) == 1 and ips[0] != "10.1.2.3" and all(1 <= int(o) <= 254 for o in ips[0].split("."))
    assert cards[0].strip() in got[7].text
    names = re.match(r"Frau (\w+) ([\w-]+) met Mr\. (\w+) ([\w-]+), Mrs (\w+) ([\w-]+) and г-н (\w+) ([\w-]+); SSN \d{3}-\d\d-\d{4}, DE", got[6].text)
    assert names[1] in pii.GIVEN["latin f"].split() and names[3] in pii.GIVEN["latin m"].split() and names[5] in pii.GIVEN["latin f"].split()
    assert names[7] in pii.GIVEN["cyrillic m"].split() and names[8].split("-")[0] in pii.FAMILY["cyrillic"].split()
    assert "123-45-6789" not in got[6].text and "3704" not in got[6].text


def test_key_changes_everything(spark):
    a, b = replaced(spark, "k"), replaced(spark, "other")
    assert all(a[i].text != b[i].text for i in (3, 4, 5, 7))
    assert {i: r.text for i, r in a.items()} == {i: r.text for i, r in replaced(spark, "k").items()}


def test_collisions_are_settled(spark):
    # Every one- and two-digit octet pattern and many short e-mails: far more draws than one round can keep apart.
    values = [("email", f"{a}{b}@x.org") for a in "abcdefghij" for b in "0123456789"]
    values += [("name", f"Mr {n}") for n in ("Ab", "Bc", "Cd", "De", "Ef", "Fg", "Gh", "Hi", "Ij", "Jk", "Kl", "Lm", "Mn", "No", "Op", "Pq", "Qr", "Rs")]
    values += [("name", f"Mr {n}") for n in pii.FAMILY["latin"].split()]
    got = rows(pii.assign(spark.createDataFrame(values, "kind string, value string"), "k"), "kind", "value", "surrogate")
    assert len(got) == len(values) == len({(k, s) for k, _, s in got})
    assert not {(k, s) for k, _, s in got} & set(values)


def test_plan_is_native_and_empty_table(spark):
    docs = documents(spark, TEXTS)
    out = pii.replace_entities(docs, "k")
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.replace_entities(docs.limit(0), "k").count() == 0


def test_query_on_table(spark):
    from tracewright.llm.queries import op7_surrogates

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_surrogates(spark, sf).collect()}
    assert sorted(got) == sorted(docs)
    python = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|(?<![\w+])\d{13,19}(?!\w)|\+1 \(\d{3}\) \d{3}-\d{4}")
    pairs = {}
    for i, text in docs.items():
        before, after = python.findall(text), python.findall(got[i].text)
        assert len(before) == len(after)
        assert (got[i].n_entities == 0) <= (text == got[i].text)
        for a, b in zip(before, after, strict=True):
            assert a != b and pairs.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(pairs) > 20 and len(set(pairs.values())) == len(pairs)
    assert not set(pairs) & set(pairs.values())


def test_very_long_runs(spark):
    n = 100_000
    texts = [
        "x@" + "a." * n, "x@" + "a-" * n + ".com", "a" * n + "@b.org", "Mr " + "A" * n, "1" * n, "1." * n, "+1 " * n, "(" * n,
        "DE00 " * n, "A1" * n, "4111 " * n, "Mr A" + "'" * n, "@" * n,
    ]
    found = pii.replace_entities(documents(spark, texts + ["mail jo@x.example.org now"]), key="k")
    got = {r.doc_id: r for r in found.select("doc_id", "n_entities", F.length("text").alias("n")).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)].n_entities == 1
    assert not any(got[i].n_entities for i in (0, 1, 2, 3, 4, 5, 11, 12))  # longer than any address or name
