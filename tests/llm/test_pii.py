import hashlib
import re

from pyspark.sql import functions as F

from scriptorium.llm import pii

from .helpers import documents, empty, odd_documents


def replace(spark, texts, **options):
    rows = pii.replace_pii(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), **options).collect()
    return {r["doc_id"]: (r["text"], r["pii_count"]) for r in rows}


def luhn(digits):
    total = sum(sum(divmod(int(d) * (i % 2 + 1), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_form_and_coreference(spark):
    out = replace(spark, ["Mail ann.lee7@corp.example.com or ANN.LEE7@CORP.EXAMPLE.COM.", "ann.lee7@corp.example.com; +1 (415) 555-2671 and +14155552671", "card 4111 1111 1111 1111 = 4111111111111111, ip 10.1.2.3 and 93.184.216.34, ssn 123-45-6789"])
    one, two, three = (out[i][0] for i in range(3))
    assert [out[i][1] for i in range(3)] == [2, 3, 5]
    found = re.search(r"Mail ([a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.example\.org) or (\S+)\.$", one)
    assert found and found[2] == found[1].upper() and two.startswith(found[1] + "; ")
    phone = re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4}) and (\+1\d{10})$", two)
    assert phone and re.sub(r"[^+\d]", "", phone[1]) == phone[2]
    card = re.search(r"card (4\d{3} \d{4} \d{4} \d{4}) = (4\d{15}), ip (10\.\S+) and (2[45]\d\.\S+), ssn \d{3}-\d{2}-\d{4}$", three)
    assert card and card[1].replace(" ", "") == card[2] != "4111111111111111" and luhn(card[2])


def test_people_keep_gender_script_and_names(spark):
    out = replace(spark, ["Mr. John Stone met Mrs. Stone and Susan Miller.", "Анна Смирнова и Иван Петров", "Susan Miller again", "张伟 13800138000, 田中さん"])
    one = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and (\w+) (\w+)\.$", out[0][0])
    assert one and one[1] in pii.MALE["latin"] and one[4] in pii.FEMALE["latin"] and one[2] == one[3] != "Stone"
    assert out[2][0] == f"{one[4]} {one[5]} again"
    she, her, _, he, his = out[1][0].split(" ")
    assert she in pii.FEMALE["cyrillic"] and he in pii.MALE["cyrillic"] and her.endswith("а") and not his.endswith("а")
    han = re.match(r"(\w)(\w) 1\d{10}, (\w{2,3})さん$", out[3][0])
    assert han and han[1] in pii.CHINESE and han[2] in pii.GIVEN_SIGNS and han[3] in pii.JAPANESE and out[3][1] == 3


def test_coreference_by_parts(spark):
    """A family name goes on being that of the full name, in all forms and documents; so does a gender that a title told once."""
    out = replace(spark, ["Mr. James Stone wrote. Mr. Stone and James Stone agree; James T. Stone too.", "Dr Stone, Prof. Stone", "Mrs Xochitl Stone", "contact Xochitl Stone", "Mr Robert Stone"])
    one = re.match(r"Mr\. (\w+) (\w+) wrote\. Mr\. (\w+) and (\w+) (\w+) agree; (\w+) ([A-Z])\. (\w+) too\.$", out[0][0])
    assert one and one[1] == one[4] == one[6] and len({one[i] for i in (2, 3, 5, 8)}) == 1
    assert out[1][0] == f"Dr {one[2]}, Prof. {one[2]}"
    she = re.match(r"Mrs (\w+) (\w+)$", out[2][0])
    assert she[2] == one[2] and she[1] in pii.FEMALE["latin"] and out[3][0] == f"contact {she[1]} {she[2]}"
    assert out[4][0].endswith(" " + one[2]) and out[4][0] != f"Mr {one[1]} {one[2]}"


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_forms_that_must_stay_valid(spark):
    out = replace(spark, ["pay GB82 WEST 1234 5698 7654 32 or DE89370400440532013000", "born 12/03/1985, DOB: 1985-03-12", "fe80:0:0:0:1:2:3:4 and 2001:db8::ff00:42:8329", "passport no. X1234567", "221B Baker Street", "020 7946 0958, 01 23 45 67 89, +44 20 7946 0958"])
    one = re.match(r"pay (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20})$", out[0][0])
    assert one and all(mod97(x.replace(" ", "")) == 1 for x in one.groups()) and "WEST" not in one[1]
    two = re.match(r"born (\d\d)/(\d\d)/(\d{4}), DOB: (\d{4})-(\d\d)-(\d\d)$", out[1][0])
    assert two and all(1 <= int(two[i]) <= 12 for i in (1, 2, 5, 6)) and out[1][0] != "born 12/03/1985, DOB: 1985-03-12"
    assert out[2][1] == 2 and re.match(r"fd[0-9a-f]{2}:.* and fd[0-9a-f]{2}:[0-9a-f]{3}::", out[2][0])
    assert re.match(r"passport no\. [A-Z]\d{7}$", out[3][0]) and out[3][0] != "passport no. X1234567"
    assert re.match(r"1\d\d[A-Z] [A-Z][a-z]+ Street$", out[4][0]) and "Baker" not in out[4][0]
    assert out[5][1] == 3 and re.match(r"0\d\d \d{4} \d{4}, 0\d( \d\d){4}, \+4\d \d\d \d{4} \d{4}$", out[5][0])


#: Texts, and what of them names somebody: what the patterns find of a hand-made sample (see the README for the recall).
LABELLED = [
    ("Alice Johnson called", ["Alice Johnson"]), ("Priya Raman and José García", ["Priya Raman", "José García"]), ("my name is Tuomas Virtanen", ["Tuomas Virtanen"]), ("Dr. Okonkwo is in", ["Dr. Okonkwo"]),
    ("From: Li Wei <li.wei@example.cn>", ["Li Wei", "li.wei@example.cn"]), ("Dear Zanele,", ["Zanele"]), ("王芳女士到了", ["王芳"]), ("Frau Schmidt-Müller", ["Frau Schmidt-Müller"]), ("Sra. Núñez", ["Sra. Núñez"]),
    ("call 0171 555 0123", ["0171 555 0123"]), ("tel 138 0013 8000", ["138 0013 8000"]), ("12 Elm Road", ["12 Elm Road"]), ("Meet Ikechukwu Adeyemi there", ["Ikechukwu Adeyemi"]), ("talk to Sven", ["Sven"]),
]


def test_recall_on_a_labelled_sample(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED)], "i int, text string")
    got = {r["i"]: r["m"] for r in df.select("i", pii._mentions(F.col("text")).alias("m")).collect()}
    found = sum(w in got[i] for i, (_, want) in enumerate(LABELLED) for w in want)
    assert found >= 13 and sum(len(w) for _, w in LABELLED) == 16 and all(set(got[i]) <= set(w) for i, (_, w) in enumerate(LABELLED))


def test_collisions_are_drawn_anew(spark):
    """Distinct entities get distinct surrogates, none of them an entity, though first draws collide."""
    families = [f"{h}{m}{t}" for h in pii._HEADS["latin"] for m in pii._MIDDLES["latin"][:8] for t in pii._TAILS["latin"][:8]]
    names = [f"{g} {f}" for g, f in zip(pii.MALE["latin"] * 64, families, strict=True)]
    out = replace(spark, names)
    new = [out[i][0] for i in range(len(names))]
    assert len(set(new)) == len(names) and not {x.split(" ")[1] for x in new} & set(families)
    first = spark.createDataFrame([(n,) for n in families], "normal string").select(pii.surrogate(F.lit("family"), F.col("normal"), F.lit("u"), pii.KEY, F.lit(0)).alias("s"))
    assert first.distinct().count() < len(families)  # the first draws alone do collide


def test_more_entities_than_surrogates_of_a_form(spark):
    """Forms with few surrogates grow: 10,000 titled names, all 100 numbers like +1 2 3, addresses without a letter to change."""
    heads = ["Abel", "Bor", "Cas", "Dov", "Eck", "Fin", "Gor", "Hol", "Ing", "Jan", "Kos", "Lov", "Mor", "Nic", "Old", "Pet", "Qua", "Ros", "Sal", "Tov"]
    people = [f"Mr {h}{a}{b}{c}" for h in heads for a in "aeiou" for b in "bcdfglmnrs" for c in ("ac", "ec", "ic", "oc", "uc", "ad", "ed", "id", "od", "ud")]
    slavs = [f"господин {h}{t}" for h in ("Аб", "Бо", "Ва", "Ге", "До", "Ер", "Жу", "Зо", "Ив", "Ка") for t in ("лин", "рин", "мин", "дин", "бин", "вин", "гин", "пин")]
    phones = [f"+1 {i} {j}" for i in range(10) for j in range(10)]
    mails = [f"_@{c}.{t}" for c in "abcdefghijklm" for t in ("com", "org", "net")]
    texts = people + slavs + phones + mails
    out = replace(spark, texts)
    new = [out[i][0] for i in range(len(texts))]
    assert len(people) == 10000 and all(out[i][1] == 1 for i in range(len(texts)))
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert all(re.match(r"Mr [A-Z][a-z]+$", x) for x in new[: len(people)]) and all(re.match(r"\+1 \d \d+$", x) for x in new if x.startswith("+"))


def test_forms_that_real_parts_use_up(spark):
    """All numbers of a form are real, for every kind that has such forms: the surrogates differ from each other and from all of them."""
    short = [f"{a}:{b}::{c}" for a in range(10) for b in range(10) for c in range(10)]
    upper = [f"AB:C{i}::D" for i in range(10)]
    phones = [f"+1 {i} {j}" for i in range(10) for j in range(10)]
    ssns = [f"000-0{i}-00{j}{k}" for i in range(3) for j in range(10) for k in range(10)]
    texts = [f"host {x}" for x in short + upper] + phones + [f"passport A12345{i}{j}" for i in range(10) for j in range(10)] + [f"{i} Elm Street" for i in range(10)] + ssns
    out = replace(spark, texts)
    new = [out[i][0] for i in range(len(texts))]
    assert all(out[i][1] == 1 for i in range(len(texts))) and len(set(new)) == len(texts) and not set(new) & set(texts)
    six = re.compile(r"host (?:[0-9a-f]{1,4}:){2}:[0-9a-f]{1,4}|host fd[0-9a-f]{2}(?::[0-9a-f]{4}){7}", re.I)
    assert all(six.fullmatch(x) for x in new if x.startswith("host"))


def digits_of(key, kind, normal, attempt):
    seed = "\x1f".join((key, kind, normal, str(attempt)))
    stream = "".join(hashlib.sha256(f"{seed}/{i}".encode()).hexdigest() for i in range(5))
    return lambda at, below: int(stream[at % 158 * 2 : at % 158 * 2 + 4], 16) % below


def plain_surrogate(kind, normal, attempt):
    draw = digits_of(pii.KEY, kind, normal, attempt)
    shaped = lambda text: "".join(str(draw(i, 10)) if c.isdigit() else chr(97 + draw(i, 26)) if c.islower() else chr(65 + draw(i, 26)) if c.isupper() else c for i, c in enumerate(text, 1))
    if kind == "ssn":
        return shaped(normal) + "".join(str(draw(i + 2, 10)) for i in range(1, attempt - pii.SAME + 1))
    if kind == "family":
        pick = lambda at, words: words[draw(at, len(words))]
        return pick(0, pii._HEADS["latin"]) + "".join(pick(i * 2 + 4, pii._MIDDLES["latin"]) for i in range(1, attempt + 2)) + pick(2, pii._TAILS["latin"])
    raise ValueError(kind)


def plain_table(kind, normals):
    """Surrogates by the rule itself: draw all, draw anew what is real or not the first of its surrogate, until nothing is."""
    attempt = dict.fromkeys(normals, 0)
    while True:
        sur = {n: plain_surrogate(kind, n, a) for n, a in attempt.items()}
        first = {}
        for n in sorted(attempt, key=lambda n: (attempt[n], n)):
            first.setdefault(sur[n], n)
        again = [n for n in attempt if sur[n] in attempt or first[sur[n]] != n]
        if not again:
            return sur
        for n in again:
            attempt[n] += 1


def test_against_plain_python(spark):
    """Spans, keyed draws, collision rounds and reassembly, done by loops."""
    families = [f"{h}an{t}" for h in ("Ash", "Bel", "Car", "Dun", "Kel") for t in pii._TAILS["latin"]] * 2
    numbers = [f"{a:03d}-{b:02d}-{c:04d}" for a in range(3) for b in range(5) for c in range(9)]
    texts = [f"Mr {f} has {n}; Dr {f}, {n}." for f, n in zip(families, numbers * 2, strict=False)]
    family, ssn = plain_table("family", sorted(set(families))), plain_table("ssn", sorted({n.replace("-", "") for n in numbers}))
    want = []
    for f, n in zip(families, numbers * 2, strict=False):
        s = ssn[n.replace("-", "")]
        s = f"{s[:3]}-{s[3:5]}-{s[5:]}"
        want.append(f"Mr {family[f]} has {s}; Dr {family[f]}, {s}.")
    out = replace(spark, texts)
    assert [out[i] for i in range(len(texts))] == [(w, 4) for w in want]


def test_key_decides(spark):
    text = ["write to ann@corp.example.com"]
    assert replace(spark, text) == replace(spark, text) != replace(spark, text, key="other")


def test_clean_texts_stay(spark):
    texts = ["The year 1984, version 3.14.15, 10% of 2,500; see §4-5.", "Er an in 12 und 1234567.", "a@b", "1.2.3", "The Quick Brown Fox May Jump", "Chapter 12 Road works", "12:30:45 and 1:2", "born in 1985", "他说今天很好", "0.123456789012",
        "Dear Customer, contact Support", "Dear Valued Customers", "contact Technical Support or Monday", "file name: Report", "version 4.10.2.1, Release: 5.6.7.8", "Daniel Street, Laura University and George Washington Bridge", "dead::beef, std::a, 12::30"]
    out = replace(spark, texts)
    assert [out[i] for i in range(len(texts))] == [(t, 0) for t in texts]


def test_names_near_roles_and_places(spark):
    """A role or a place spares its own words alone; a version's number is no address, though another place has one of the same digits; short addresses of machines are found."""
    out = replace(spark, ["Dear Tamsin, contact Xochitl Stone in Support", "Jane Doe of Laura Hall", "server 4.10.2.1 has version 4.10.2.1", "ping fe80::1 or 2001::7:ff"])
    one = re.match(r"Dear (\S+), contact (\w+) (\w+) in Support$", out[0][0])
    assert one and out[0][1] == 2 and "Tamsin" not in out[0][0] and "Stone" not in out[0][0]
    two = re.match(r"(\w+) \w+ of (\w+) (\w+)$", out[1][0])
    assert two and two[1] in pii.FEMALE["latin"] and two[2] in pii.FEMALE["latin"] and two[3] != "Hall"
    assert re.match(r"server 2[45]\d\.\S+ has version 4\.10\.2\.1$", out[2][0]) and out[2][1] == 1
    assert re.match(r"ping fd\d\d::\d or fd\d\d::\d:[a-f]{2}$", out[3][0]) and out[3][1] == 2


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "pii_count"]
    assert sorted(map(str, out.drop("pii_count").collect())) == sorted(map(str, docs.collect()))
    assert pii.replace_pii(empty(spark)).count() == 0


def test_columns_of_any_name_and_type(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'ask ann@corp.example.com' AS text, map('a', 1) AS `row`, 'x' AS `of`, 'y' AS again, 3 AS hits, 4 AS _id, 5 AS _again, 6 AS _new, 7 AS _found, 8 AS at, 9 AS PII_COUNT, 2 AS `a.b`")
    out = pii.replace_pii(df)
    assert out.columns == [*[c for c in df.columns if c != "PII_COUNT"], "pii_count"]
    row = out.first()
    assert row["row"] == {"a": 1} and row["_found"] == 7 and row["a.b"] == 2 and row["pii_count"] == 1 and row["text"].startswith("ask ") and "ann@" not in row["text"]
    assert pii.replace_pii(df, count=None).columns == df.columns
