"""PII: surrogate generation. DataFrame functions only.

Entities are found by patterns: addresses of mail, machines and houses, numbers of telephones,
cards, accounts, passports and social security, secrets, dates of birth, and persons (a title,
a known given name with a family name, a phrase that introduces a name, a mail address behind
it, or a Chinese or Japanese family name with its form of address; none where a role follows
the phrase, as in "Dear Customer", or the name is a place's, as in "Daniel Street"). Each is made of parts: a person of a given
and a family name, all others of one part. A part gets a surrogate that is keyed (a hash of
key, kind and the part's normal form), of the same kind and form: digits for digits and letters
for letters, the mention's own punctuation, check digits that stay right, an address range of
the same sort, a given name of the same gender, names of the same script. The normal form
decides, so that all mentions in the corpus, however they are written, get one surrogate, and
"Mr. Stone" goes on being the Stone of "James Stone".

Collision checks run over the dictionary of distinct parts: a surrogate that two parts share, or
that is itself a part of the corpus, is drawn anew for all but the first, until there is none.
What is drawn from grows with the attempt, so that there always is one left: family names get
syllables, given names a second one behind a hyphen, and after SAME attempts in their own form
numbers get digits and addresses letters or octets (secrets and account numbers have 10**8
surrogates a form at least and keep it). Two kinds are not held apart: dates of birth, which
name nobody, may meet; and a given name's surrogate may be another's real given name, since
the family name tells them apart. Only parts that were redrawn, or whose gender is told
elsewhere in the corpus, are kept as a table, and only texts that mention one meet it in a join.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_names, written

#: The key is a parameter; this one is for tests and the registered queries.
KEY = "scriptorium"
#: Given names that surrogates are drawn from, by gender and script.
MALE = {"latin": ["James", "Robert", "Thomas", "Daniel", "Matthew", "Andrew", "Joseph", "Kevin", "Brian", "George", "Edward", "Steven", "Henry", "Jacob", "Peter", "Walter"], "cyrillic": ["Иван", "Пётр", "Андрей", "Сергей", "Дмитрий", "Николай", "Михаил", "Павел"]}
FEMALE = {"latin": ["Mary", "Linda", "Susan", "Jessica", "Karen", "Nancy", "Margaret", "Sandra", "Ashley", "Emily", "Donna", "Carol", "Michelle", "Laura", "Sarah", "Julia"], "cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"]}
#: More given names that tell a person, and with it a gender.
KNOWN_MALE = [*MALE["latin"], *MALE["cyrillic"], "John", "Michael", "David", "William", "Richard", "Charles", "Christopher", "Anthony", "Mark", "Donald", "Paul", "Joshua", "Kenneth", "Timothy", "Jason", "Jeffrey", "Ryan", "Gary", "Nicholas", "Eric", "Jonathan", "Stephen", "Larry", "Scott", "Frank", "Samuel", "Benjamin", "Patrick", "Alexander", "Jack", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Michel", "Jacques", "François", "José", "Juan", "Carlos", "Luis", "Miguel", "Giovanni", "Marco", "Ahmed", "Mohammed", "Omar", "Raj", "Arjun", "Hiroshi", "Kenji", "Adam", "Dennis", "Gregory", "Martin", "Philip", "Simon", "Алексей", "Владимир", "Александр"]
KNOWN_FEMALE = [*FEMALE["latin"], *FEMALE["cyrillic"], "Alice", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Lisa", "Betty", "Dorothy", "Kimberly", "Deborah", "Stephanie", "Rebecca", "Sharon", "Cynthia", "Kathleen", "Amy", "Angela", "Anna", "Ruth", "Brenda", "Pamela", "Nicole", "Katherine", "Samantha", "Christine", "Emma", "Catherine", "Rachel", "Maria", "Heather", "Diane", "Ursula", "Sabine", "Ingrid", "Renate", "Marie", "Sophie", "Isabelle", "Camille", "Carmen", "Lucía", "Ana", "Isabel", "Giulia", "Francesca", "Fatima", "Aisha", "Priya", "Ananya", "Yuki", "Keiko", "Jane", "Helen", "Claire", "Hannah", "Julie", "Martha", "Janet", "Olivia", "Екатерина", "Людмила"]
MALE_TITLES, FEMALE_TITLES = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин"], ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа"]
TITLES = [*MALE_TITLES, *FEMALE_TITLES, "Dr", "Prof", "Professor"]
#: Phrases that a name follows, of one word or more; and those that only tell a name of two.
CUES = ["my name is ", "My name is ", "Dear ", "signed, ", "Signed, ", "Je m'appelle ", "je m'appelle ", "Mein Name ist ", "mein Name ist ", "Me llamo ", "me llamo ", "Меня зовут ", "меня зовут "]
CUES_OF_TWO = ["name: ", "Name: ", "contact ", "Contact: "]
#: Words that stand in a name's place and name nobody; words that end the name of a place or prize; and such that are family names as well.
ROLES = ["Admin", "Administrator", "All", "Applicant", "Applicants", "Client", "Clients", "Colleague", "Colleagues", "Customer", "Customers", "Diary", "Editor", "Everyone", "Friend", "Friends", "Guest", "Guests", "Madam", "Manager", "Member", "Members", "Office", "Parent", "Parents", "Partner", "Partners", "Reader", "Readers", "Sales", "Service", "Services", "Sir", "Sirs", "Staff", "Student", "Students", "Support", "Team", "User", "Users"]
PLACES = ["Airport", "Avenue", "Award", "Boulevard", "Bridge", "College", "County", "Foundation", "Hospital", "Institute", "Library", "Museum", "Prize", "Road", "School", "Square", "Stadium", "Station", "Street", "Theatre", "University"]
PLACES_OR_FAMILIES = ["Church", "Hall", "House", "Lake", "Lane", "Park"]
#: Family names of Chinese (one sign) and Japanese (two), and signs of given names.
CHINESE, JAPANESE = list("王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗郑梁谢宋唐许邓冯韩曹"), ["佐藤", "鈴木", "高橋", "田中", "渡辺", "伊藤", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上"]
GIVEN_SIGNS = list("伟芳娜敏静丽强磊军洋勇艳杰涛明超平刚文华建国英红玉兰志海")
_HEADS = {"latin": ["Ash", "Bel", "Car", "Dun", "Ell", "Far", "Gar", "Hal", "Kel", "Lan", "Mar", "Nor", "Pres", "Rad", "Sel", "Wind"], "cyrillic": ["Бел", "Вол", "Гор", "Дор", "Кар", "Лав", "Мор", "Нов"]}
_TAILS = {"latin": ["berg", "bury", "combe", "dale", "field", "ford", "gate", "ham", "hurst", "ley", "man", "mont", "more", "stone", "ton", "well"], "cyrillic": ["ин", "ов", "енко", "ский", "ев", "ко", "ук", "ян"], "cyrillic female": ["ина", "ова", "ева", "ская"]}
_MIDDLES = {"latin": ["an", "el", "or", "in", "ar", "en", "il", "on", "as", "er", "ul", "am", "os", "et", "iv", "ad"], "cyrillic": ["ан", "ел", "ор", "ин", "ар", "ен", "ол", "ам"]}
#: Attempts in an entity's own form before it grows, and rounds of redrawing: after so many, forms have 10**60 surrogates more.
SAME, ROUNDS = 3, 64

def _trie(words: list[str]) -> str:
    """A pattern of all words, longest first, that branches letter by letter: one look at a letter rules most words out."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    if set(heads) <= {""}:
        return ""
    parts = [h + _trie(rest) for h, rest in heads.items() if h]
    if len(parts) == 1 and "" not in heads:
        return parts[0]
    return f"(?:{'|'.join(parts)}){'?' if '' in heads else ''}"


_TITLES, _GIVEN = _trie(TITLES), _trie([*KNOWN_MALE, *KNOWN_FEMALE])
_PROPER = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
_INITIAL = r"(?: \p{Lu}\.)?"
#: Not a role, alone or as the second word; not a place's word, as the family name or right behind it.
_NO_ROLE = rf"(?!(?:\p{{Lu}}\p{{Ll}}{{1,30}} )?{_trie(ROLES)}(?!\p{{L}}))"
_NO_PLACE = rf"(?!{_trie(PLACES)}(?!\p{{L}}))"
_NO_PLACE_BEHIND = rf"(?! {_trie([*PLACES, *PLACES_OR_FAMILIES])}(?!\p{{L}}))"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DATE = r"(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})"
_PASSPORT = "[A-Z]{1,2}[0-9]{6,8}"
#: What an entity of each kind looks like, in the order in which kinds are tried where a word begins.
KINDS = {
    "email": r"(?<![._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![.,-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ip": rf"(?<!\.)(?<!\b(?i:version|ver|release|firmware|build)[ .:]{{0,2}}){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5}|(?=[0-9a-fA-F]{0,3}[0-9])[0-9a-fA-F]{3,4}:(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![+.-])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}|1[3-9][0-9]{9}|1[3-9][0-9][ -][0-9]{4}[ -][0-9]{4})(?![0-9])",
    "street": rf"(?<![.,-])[0-9]{{1,5}}[A-Z]? {_PROPER} (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?![A-Za-z])",
    "person": rf"(?:{_TITLES}\.? {_PROPER}{_INITIAL}(?: {_PROPER})?|{_GIVEN}{_INITIAL} {_NO_PLACE}{_PROPER}(?!\p{{L}}){_NO_PLACE_BEHIND})(?!\p{{L}})",
}
#: Letters and signs that mentions of some kinds begin with; others may begin with any.
_BEGINS = {"iban": "[A-Z]", "card": "[0-9]", "ip": "[0-9]", "ipv6": "[0-9a-fA-F]", "ssn": "[0-9]", "phone": r"[0-9+(]", "street": "[0-9]", "person": r"\p{Lu}|\p{Ll}", "secret": "[0-9A-Fa-fsg]"}
#: What is found by what stands around it: (context before, or None; own form; context after).
WORDS_OF_BIRTH = ["born", "dob", "born on", "date of birth", "geboren am", "né le", "née le", "nacido el"]
WORDS_OF_PASSPORT = ["passport", "passport no", "passport no.", "passport number", "passeport", "reisepass"]
_HAN = rf"(?=\p{{IsHan}})(?:{_trie(JAPANESE)}\p{{IsHan}}{{0,3}}(?=さん|様|氏|先生)|[{''.join(CHINESE)}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐|老师|教授| ?1[3-9][0-9]{{9}}(?![0-9]))|(?<=姓名[:：])[{''.join(CHINESE)}]\p{{IsHan}}{{1,2}})"
IN_CONTEXT = [
    rf"(?=[0-9])(?<=(?i:{'|'.join(WORDS_OF_BIRTH)})[: ]{{1,2}}){_DATE}(?![0-9])",
    rf"(?=[A-Z])(?<=(?i:{'|'.join(re.escape(w) for w in WORDS_OF_PASSPORT)})[: ]{{1,2}}){_PASSPORT}(?![0-9A-Za-z])",
    rf"(?=\p{{Lu}})(?<={'|'.join(CUES)}){_NO_ROLE}{_PROPER}{_INITIAL}(?: {_PROPER})?(?!\p{{L}})",
    rf"(?=\p{{Lu}})(?<={'|'.join(CUES_OF_TWO)}){_NO_ROLE}{_PROPER}{_INITIAL} {_PROPER}(?!\p{{L}})",
    rf"(?=\p{{Lu}}){_PROPER}{_INITIAL} {_PROPER}(?= [<(][A-Za-z0-9._%+-]{{1,64}}@)",
]
#: All patterns begin where a word does (no letter or digit before), but for names in Chinese and Japanese.
_branch = lambda kind: rf"(?={_BEGINS[kind]}){KINDS[kind]}" if kind in _BEGINS else KINDS[kind]
_ALONE = "|".join(f"(?:{_branch(k)})" for k in KINDS)
PLAIN = rf"(?<![\p{{L}}\p{{N}}])(?:{_ALONE})"
FULL = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'(?:{p})' for p in IN_CONTEXT)}|{_ALONE})|{_HAN}"
DIGIT_KINDS = ("card", "ssn", "phone")
#: Kinds whose surrogates must differ from each other, and those that must differ from all real parts as well.
APART = ("email", "secret", "iban", "card", "ip", "ipv6", "ssn", "phone", "passport", "street", "given", "family")
NO_REAL = tuple(k for k in APART if k != "given")


def _kind(mention: Column) -> Column:
    forms = {"birth": _DATE, **{k: p for k, p in KINDS.items() if k != "person"}, "passport": _PASSPORT}
    out = F.lit("person")
    for name, pattern in reversed(forms.items()):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), name).otherwise(out)
    return out


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _name(mention: Column) -> Column:
    """A person's mention as (title, given, initial, family, han); missing parts are empty."""
    title = F.regexp_extract(mention, rf"^(?:(?:{_TITLES})\.? )?", 0)

    def told(x: Column) -> Column:
        title, words = x["title"], x["words"]
        first, last, n = F.element_at(words, 1), F.element_at(words, -1), F.size(words)
        han = first.rlike(r"^\p{IsHan}")
        family = F.regexp_extract(first, rf"^(?:{_trie(JAPANESE)}|.)", 0)
        alone = (n == 1) & (title == "") & first.isin(*KNOWN_MALE, *KNOWN_FEMALE)
        dotted = F.element_at(words, F.least(n, F.lit(2))).endswith(".")
        return F.struct(
            title.alias("title"), F.when(han, F.substring(first, F.length(family) + 1, F.length(first))).when(alone | (n > 1), first).otherwise("").alias("given"),
            F.when(~han & (n > 1) & dotted, F.element_at(words, F.least(n, F.lit(2)))).otherwise("").alias("initial"),
            F.when(han, family).when(alone | ((n == 2) & dotted), "").otherwise(last).alias("family"), han.alias("han"),
        )

    return _let(F.struct(title.alias("title"), F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ").alias("words")), told)


def _gender(title: Column, given: Column) -> Column:
    """m or f by the given name, else by the title, else u."""
    bare = F.regexp_replace(title, r"\.? $", "")
    return F.when(given.isin(*KNOWN_FEMALE), "f").when(given.isin(*KNOWN_MALE), "m").when(bare.isin(*FEMALE_TITLES), "f").when(bare.isin(*MALE_TITLES), "m").otherwise("u")


def normal_form(kind: Column, mention: Column) -> Column:
    """What tells two mentions of one entity (no person) apart from two entities."""
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.concat(F.when(mention.startswith("+"), "+").otherwise(""), F.regexp_replace(mention, "[^0-9]", "")))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ipv6"), F.lower(mention))
        .otherwise(mention)
    )


def _parts(mention: Column) -> Column:
    """The parts of a mention that get surrogates: array of (kind, normal, gender)."""
    part = lambda kind, normal, gender: F.struct(kind.alias("kind"), normal.alias("normal"), gender.alias("gender"))
    none = F.lit("u")
    person = lambda p: F.filter(F.array(part(F.lit("given"), p["given"], _gender(p["title"], p["given"])), part(F.lit("family"), p["family"], none)), lambda x: x["normal"] != "")
    return _let(_kind(mention), lambda kind: F.when(kind == "person", _let(_name(mention), person)).otherwise(F.array(part(kind, normal_form(kind, mention), none))))


def _stream(seed: Column, blocks: int = 5) -> Column:
    """Keyed hex digits, 64 a block."""
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"/{i}")).cast("binary"), 256) for i in range(blocks)])


def _draw(stream: Column, at: Column, below: int) -> Column:
    """A number under `below` from four hex digits of the stream; the stream is read round."""
    return (F.conv(F.substring(stream, (F.pmod(at, F.lit(158)) * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _pick(stream: Column, at: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _draw(stream, at, len(words)) + 1)


def _more(n: Column, part) -> Column:
    """part(1), part(2), ... part(n) in a row; nothing for n under 1."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), part), "")).otherwise("")


def _same_shape(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits, small and capital letters for their like; all else stays."""
    letters, low, high = ("abcdef", 6, "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    char = lambda i: F.substring(text, i, F.lit(1))
    one = lambda i: (
        F.when(char(i).rlike("[0-9]"), _draw(stream, i, 10).cast("string"))
        .when(char(i).rlike("[a-z]"), F.substring(F.lit(letters), _draw(stream, i, low) + 1, F.lit(1)))
        .when(char(i).rlike("[A-Z]"), F.substring(F.lit(high), _draw(stream, i, low) + 1, F.lit(1)))
        .otherwise(char(i))
    )
    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose check digit is yet to come: the last digit counts twice."""
    d = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 1, d(i)).otherwise(F.when(d(i) > 4, d(i) * 2 - 9).otherwise(d(i) * 2))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda n, i: n + term(i))


def _check_digit(body: Column) -> Column:
    return (F.lit(10) - _luhn_sum(body) % 10) % 10


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters (A is 10 and so on) read as one number."""
    def step(n: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), n * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).otherwise(n * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def surrogate(kind: Column, normal: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a part's normal form, itself a normal form of the same kind."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string"))
    # the domain of an address goes by itself, so that one domain stays one domain
    host = F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.split_part(normal, F.lit("@"), F.lit(2)))
    names = lambda s: F.when(kind == "given", _given(normal, gender, s, attempt)).otherwise(_family(normal, s, attempt))
    return _let(_stream(seed), lambda s: F.when(kind == "email", _let(_stream(host), lambda h: _email(normal, s, h, attempt))).when(kind.isin("given", "family"), names(s)).otherwise(_other(kind, normal, s, attempt)))


def _letter(stream: Column, at: Column) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(stream, at, 26) + 1, F.lit(1))


def _email(normal: Column, stream: Column, host: Column, attempt: Column) -> Column:
    local, domain = F.split_part(normal, F.lit("@"), F.lit(1)), F.split_part(normal, F.lit("@"), F.lit(2))
    return F.concat(_same_shape(local, stream), _more(attempt - SAME, lambda i: _letter(stream, i + 2)), F.lit("@"), _same_shape(F.split_part(domain, F.lit("."), F.lit(1)), host), F.lit(".example.org"))


def _given(normal: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A name of the script and gender; each attempt has one more behind a hyphen."""

    def of(script: str) -> Column:
        one = lambda i: F.when(gender == "m", _pick(stream, i, MALE[script])).when(gender == "f", _pick(stream, i, FEMALE[script])).otherwise(_pick(stream, i, MALE[script] + FEMALE[script]))
        return F.concat(one(F.lit(0)), _more(attempt, lambda i: F.concat(F.lit("-"), one(i * 2))))

    signs = _more(F.length(normal) + attempt, lambda i: _pick(stream, i * 2, GIVEN_SIGNS))
    return F.when(normal.rlike(r"^\p{IsHan}"), signs).when(normal.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _family(normal: Column, stream: Column, attempt: Column) -> Column:
    """A name of syllables, one more each attempt; double names stay double."""

    def of(script: str, tails: list[str], at: int) -> Column:
        return F.concat(_pick(stream, F.lit(at), _HEADS[script]), _more(attempt + 1, lambda i: _pick(stream, i * 2 + at + 4, _MIDDLES[script])), _pick(stream, F.lit(at + 2), tails))

    latin = F.concat(of("latin", _TAILS["latin"], 0), F.when(normal.contains("-"), F.concat(F.lit("-"), of("latin", _TAILS["latin"], 80))).otherwise(""))
    cyrillic = F.when(normal.endswith("а") | normal.endswith("ая"), of("cyrillic", _TAILS["cyrillic female"], 0)).otherwise(of("cyrillic", _TAILS["cyrillic"], 0))
    more = _more(attempt, lambda i: _pick(stream, i * 2 + 2, GIVEN_SIGNS))
    han = F.concat(F.when(F.length(normal) == 1, _pick(stream, F.lit(0), CHINESE)).otherwise(_pick(stream, F.lit(0), JAPANESE)), more)
    return F.when(normal.rlike(r"^\p{IsHan}"), han).when(normal.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def _other(kind: Column, normal: Column, stream: Column, attempt: Column) -> Column:
    shaped = _same_shape(normal, stream)
    more = _more(attempt - SAME, lambda i: _draw(stream, i + 2, 10).cast("string"))
    body = F.concat(F.substring(normal, 1, 1), F.substring(shaped, F.lit(2), F.length(normal) - 2), more)
    true_body = F.substring(normal, F.lit(1), F.length(normal) - 1)
    valid = _check_digit(true_body) == F.substring(normal, -1, 1).cast("int")
    # a card keeps its first digit (its issuer's sort), and a valid check digit stays valid
    card = F.concat(body, F.when(valid, _check_digit(body).cast("string")).otherwise(F.substring(shaped, -1, 1)))
    # a telephone number keeps the first digit of its country code
    phone = F.when(normal.startswith("+"), F.concat(F.substring(normal, 1, 2), F.substring(shaped, F.lit(3), F.length(normal)), more)).otherwise(F.concat(F.substring(normal, 1, 1), F.substring(shaped, F.lit(2), F.length(normal)), more))
    octet = lambda i: _draw(stream, i, 256).cast("string")
    private = normal.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    ip = F.concat_ws(".", F.when(private, F.lit("10")).otherwise((_draw(stream, F.lit(0), 15) + 240).cast("string")), *[octet(F.lit(i)) for i in (1, 2, 3)])
    ip = F.concat(ip, _more(attempt - SAME, lambda i: F.concat(F.lit("."), octet(i + 2))))
    hexes = normal.rlike("^[0-9a-fA-F]+$")
    prefix = F.regexp_extract(normal, "^(?:AKIA|sk-|ghp_)?", 0)
    secret = F.when(hexes, _same_shape(normal, stream, hexadecimal=True)).otherwise(F.concat(prefix, _same_shape(F.substring(normal, F.length(prefix) + 1, F.length(normal)), stream)))
    # an account number keeps its country, and right check digits stay right
    country, account = F.substring(normal, 1, 2), F.substring(shaped, F.lit(5), F.length(normal))
    right = _mod97(F.concat(F.substring(normal, F.lit(5), F.length(normal)), country, F.substring(normal, 3, 2))) == 1
    iban = F.concat(country, F.when(right, F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(shaped, 3, 2)), account)
    ipv6 = F.concat(F.lit("fd"), F.substring(_same_shape(normal, stream, hexadecimal=True), F.lit(3), F.length(normal)))
    ipv6 = F.when(normal.rlike("^[0-9a-f]{4}:"), ipv6).otherwise(_same_shape(normal, stream, hexadecimal=True))
    # a form of few digits may have no free surrogate left: then whole addresses of the private block
    whole = F.regexp_replace(F.concat(F.lit("fd"), F.substring(stream, 1, 30)), "(....)(?=.)", "$1:")
    ipv6 = F.when(attempt > SAME, whole).otherwise(ipv6)
    # fields of a date: four digits a year, others 1 to 12, so that every order of them is a date
    fields, marks = F.split(normal, "[-/.]", -1), F.regexp_extract_all(normal, F.lit("[-/.]"), F.lit(0))
    field = lambda x, i: F.when(F.length(x) == 4, (_draw(stream, i * 2, 65) + 1940).cast("string")).when(F.length(x) == 2, F.lpad((_draw(stream, i * 2, 12) + 1).cast("string"), 2, "0")).otherwise((_draw(stream, i * 2, 9) + 1).cast("string"))
    birth = F.array_join(F.flatten(F.zip_with(F.transform(fields, field), marks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    number, rest = F.regexp_extract(normal, "^[0-9]+[A-Z]?", 0), F.split_part(normal, F.lit(" "), F.lit(3))
    street = F.concat_ws(" ", F.concat(F.lit("1"), F.substring(_same_shape(number, stream), 2, 9)), _family(F.lit("x"), stream, attempt), rest)
    out = F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "iban", iban)
    return out.when(kind == "ipv6", ipv6).when(kind == "birth", birth).when(kind == "street", street).when(kind.isin("ssn", "passport"), F.concat(shaped, more)).otherwise(shaped)


def _written_like(kind: Column, mention: Column, replacement: Column) -> Column:
    """A surrogate's normal form in the form of the mention (no person)."""
    digits = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9]", ""))
    solid = lambda i: F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))
    refill = lambda keep, count, source: F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(F.substring(mention, i, F.lit(1)).rlike(keep), F.substring(source, count(i), F.lit(1))).otherwise(F.substring(mention, i, F.lit(1)))), "")
    plain = F.replace(replacement, F.lit("+"), F.lit(""))
    rest = F.substring(plain, digits(F.length(mention)) + 1, F.length(plain))
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.concat(refill("[0-9]", digits, plain), rest))
        .when(kind == "iban", refill("[^ ]", solid, replacement))
        .when(kind.isin("email", "ipv6") & (mention == F.upper(mention)), F.upper(replacement))
        .otherwise(replacement)
    )


def _in_context(text: Column) -> Column:
    """Whether a text has what the patterns of IN_CONTEXT or names in Chinese and Japanese ask for: plain searches, since few texts do."""
    low = F.lower(text)
    words = [low.contains(w) for w in ("born", "dob", "date of birth", "geboren", "né", "nacido", "pass")]
    cues = [text.contains(c) for c in [*CUES, *CUES_OF_TWO]]
    return reduce(or_, [*words, *cues, text.contains("@") & (text.contains("<") | text.contains("(")), text.rlike(r"\p{IsHan}")])


def _mentions(text: Column) -> Column:
    """Every entity of a text, in order."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(_in_context(text), found(FULL)).otherwise(found(PLAIN))


def _text_key(text: Column) -> Column:
    """What tells texts apart: rows with the same text share what is known of it."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(at, kind, normal, gender): the parts of the entities of each text, once each; `at` is the text's key.

    Null and empty texts have none; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(_text_key(text).alias("at"), F.explode(F.array_distinct(_mentions(text))).alias("mention"))
    return each.select("at", F.explode(_parts(F.col("mention"))).alias("p")).select("at", "p.*").distinct()


def redrawn(known: DataFrame, key: str) -> DataFrame:
    """(kind, normal, gender, attempt) of all parts; attempts are such that no two surrogates of a kind in APART are alike, and none of NO_REAL is a real part.

    A part's gender is the one that the corpus tells: u if it tells none, or both.
    """
    draw = lambda df: df.withColumn("sur", surrogate(F.col("kind"), F.col("normal"), F.col("gender"), key, F.col("attempt")))
    told = F.collect_set(F.when(F.col("gender") != "u", F.col("gender")))
    parts = known.groupBy("kind", "normal").agg(F.when(F.size(told) == 1, told[0]).otherwise("u").alias("gender"))
    now = written(draw(parts.withColumn("attempt", F.lit(0))), "pii-surrogates")
    for _ in range(ROUNDS):
        real = now.where(F.col("kind").isin(*NO_REAL)).select(F.col("kind").alias("_k"), F.col("normal").alias("_n"), F.lit(True).alias("_real"))
        first = W.partitionBy("kind", "sur").orderBy("attempt", "normal")
        judged = now.join(real, (F.col("kind") == F.col("_k")) & (F.col("sur") == F.col("_n")), "left").withColumn("_at", F.row_number().over(first))
        clash = F.col("kind").isin(*APART) & (F.col("_real").isNotNull() | (F.col("_at") > 1))
        again = written(judged.where(clash).select("kind", "normal", "gender", (F.col("attempt") + 1).alias("attempt")), "pii-again")
        if again.limit(1).count() == 0:
            return now
        kept = now.join(again, ["kind", "normal"], "left_anti")
        before, now = now, written(kept.unionByName(draw(again)), "pii-surrogates")
        discard(before)
        discard(again)
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_pii(docs: DataFrame, *, key: str = KEY, text_col: str = "text", count: str | None = "pii_count") -> DataFrame:
    """docs with surrogates in the place of entities, and `count`, their number, as a last column.

    A null text stays null, an empty one empty, both with 0 entities; null and repeated ids and
    repeated rows are rows like others; an empty table gives none; other columns, of any name
    and type, are kept as they are (an old column `count` is replaced; None adds none). Reruns
    with the same key agree, whatever the partitions.
    """
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if count is None or c.lower() != count.lower()])
    found = written(entities(base, text_col), "pii-entities")
    drawn = redrawn(found, key)
    differ = F.col("attempt").isin(0) & (F.col("gender") == F.col("_g"))
    odd = found.withColumnRenamed("gender", "_g").join(drawn, ["kind", "normal"]).where(~differ)
    value = F.struct("attempt", "gender")
    row, of, again, hits = free_names(base, "row", "of", "again", "hits")
    odd = odd.groupBy(F.col("at").alias(of)).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws(":", "kind", "normal").alias("k"), value.alias("v"))))).alias(again))
    odd = written(odd, "pii-redrawn")
    discard(found)
    discard(drawn)
    text = F.coalesce(F.col(f"{row}.{text_col}"), F.lit(""))
    rows = base.select(F.struct(*[base[f"`{c}`"] for c in base.columns]).alias(row)).withColumn(hits, _mentions(text)).join(odd, _text_key(text) == F.col(of), "left")

    def drawn_for(part: Column) -> Column:
        seen = F.try_element_at(F.col(again), F.concat_ws(":", part["kind"], part["normal"]))
        return surrogate(part["kind"], part["normal"], F.coalesce(seen["gender"], part["gender"]), key, F.coalesce(seen["attempt"], F.lit(0)))

    def person(mention: Column, parts: Column) -> Column:
        def told(p: Column) -> Column:
            of = lambda kind: F.coalesce(F.try_element_at(F.filter(p["parts"], lambda x: x["kind"] == kind), F.lit(1))["sur"], F.lit(""))
            drawn = F.sha2(F.concat_ws("\x1f", F.lit(key), p["name"]["initial"]).cast("binary"), 256)
            initial = F.when(p["name"]["initial"] != "", F.concat(F.upper(_letter(drawn, F.lit(0))), F.lit("."))).otherwise("")
            words = F.filter(F.array(of("given"), initial, of("family")), lambda w: w != "")
            return F.concat(p["name"]["title"], F.when(p["name"]["han"], F.concat(of("family"), of("given"))).otherwise(F.array_join(words, " ")))

        return _let(F.struct(_name(mention).alias("name"), parts.alias("parts")), told)

    def new(mention: Column) -> Column:
        parts = F.transform(_parts(mention), lambda p: F.struct(p["kind"].alias("kind"), drawn_for(p).alias("sur")))
        one = lambda p: F.when(F.element_at(p, 1)["kind"].isin("given", "family"), person(mention, p)).otherwise(_written_like(F.element_at(p, 1)["kind"], mention, F.element_at(p, 1)["sur"]))
        return _let(parts, one)

    between = F.when(_in_context(text), F.split(text, FULL, -1)).otherwise(F.split(text, PLAIN, -1))
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(F.col(hits), new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.when(F.size(hits) > 0, joined).otherwise(F.col(f"{row}.{text_col}"))
    columns = [changed.alias(c) if c == text_col else F.col(row).getField(c).alias(c) for c in base.columns]
    return rows.select(*columns, *([F.size(hits).cast("long").alias(count)] if count else []))
