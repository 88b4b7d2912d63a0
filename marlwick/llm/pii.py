"""PII: surrogates for detected entities, keyed, consistent in type, format, script and gender.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, payment cards, social security numbers, IBANs and the names of
persons.  A name is found by a first name that NAMES lists beside a surname (in either order, in title case or capitals), by a
title before it (Mr, Frau, Señora ..), by words that introduce one (my name is, Name:, Sincerely ..), by a patronymic, or by an
honorific after it (Han).  A person of whom none of these is there, whose first name isn't listed, is not found: that is the
limit of rules without a model of names.  First names and surnames alone are found where the same text has them in full.

Each entity is replaced by another of its kind: same length and punctuation, letters for letters (vowels for vowels, of the same
script and case), digits for digits; telephone numbers keep their country code, cards their network and their standing under
the Luhn check, IBANs are valid, listed first names become listed ones of the same gender and script, and gendered endings of
surnames stay.  Spelling is laid aside first: one number in several formats, one address in several cases, one name in
capitals or not, are one entity with one surrogate, which takes the spelling of each place.

A surrogate is the image under a permutation, keyed, of all strings of the entity's form: a Feistel network E makes the keyed
permutation x -> E(E^-1(x) + k), which fixes nothing.  So one entity has one surrogate in the whole corpus, two entities never
share one, and none is its own; nothing need be gathered or looked up.  The collision check is the inverse: every surrogate is
led back, and must give its entity, or it is drawn again by another key.  collisions() looks for any over a corpus.

The key is a parameter, spark.marlwick.pii.key in queries.

Defined cases: null text stays null with no entities; text without entities stays as it is.  Where entities overlap, the one
that starts first, then the longer, stands.  Rows are independent, and repeated rows get the same surrogates.  Strings whose
form has one member only (no letter or digit to change) are left.  An IBAN whose check digits can't occur (00, 01, 99) is none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, slices

KEY = "marlwick-development-key"

# --- detection

_LATIN_UP, _LATIN = "A-ZÀ-ÖØ-ÞĀ-Ž", "a-zß-öø-ÿā-ž"
_EMAIL = re.compile(rf"(?<![0-9{_LATIN_UP}{_LATIN}._%+\-])[0-9{_LATIN_UP}{_LATIN}][0-9{_LATIN_UP}{_LATIN}._%+\-]*@[0-9{_LATIN_UP}{_LATIN}\-]+(?:\.[0-9{_LATIN_UP}{_LATIN}\-]+)*\.[A-Za-z]{{2,}}")
_PHONE = re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[.\-]\d{4}|\(?0\d{1,4}\)?[ \-]\d{3,4}[ \-]\d{3,4})(?!\w|[\-.]\d)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.+\-])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ \-])\d{6}\2\d{5}|\d{13,19})(?!\w)")
_SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")

NAMES = {
    ("latin", "f"): "Abigail Adriana Agnes Alexandra Alice Amanda Amelia Andrea Angela Anita Anna Anne Antonia Ayesha Barbara Beatriz Brenda Camille Carla Carmen Carol Caroline Catherine Charlotte Chiara Christina Christine Claire Claudia Cynthia Deborah Denise Diana Dorothy Eleanor Elena Elisabeth Elizabeth Ellen Emily Emma Erika Esther Eva Fatima Fernanda Fiona Florence Francesca Gabriela Giulia Gloria Greta Hannah Heather Heidi Helen Helga Inés Ingrid Irene Isabel Isabella Jane Janet Jennifer Jessica Joan Johanna Josephine Judith Julia Julie Karen Karin Katharina Kathleen Laura Lena Linda Lisa Lucia Luisa Madeleine Margaret Maria María Marie Marta Martha Martina Mary Melissa Mercedes Michelle Monica Monika Nancy Natalie Nathalie Nicole Nora Olivia Pamela Patricia Paula Petra Pilar Priya Rachel Rebecca Renate Rita Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Simone Sofia Sonia Sophia Sophie Stefanie Stephanie Susan Susanne Teresa Ursula Valentina Vanessa Veronica Victoria Virginia Yasmin Yvonne Zoe".split(),
    ("latin", "m"): "Aaron Adam Ahmed Alan Albert Alejandro Alexander Alfonso Ali Andreas Andrew Anthony Antonio Arthur Benjamin Bernard Brian Bruno Carl Carlos Charles Christian Christopher Daniel David Dennis Diego Dieter Dominik Donald Douglas Edward Eduardo Emil Enrique Eric Ernst Ethan Eugene Felix Fernando Francis Francisco Frank François Franz Friedrich Gabriel Gary George Georg Gerald Gerhard Gilbert Giovanni Gregory Guillaume Gustav Hans Harald Harold Heinrich Helmut Henri Henry Herbert Hugo Hussein Ibrahim Jack Jacob Jacques James Jason Javier Jean Jeffrey Jerry Joachim Johann Johannes John Jonathan Jorge José Joseph Joshua Juan Julian Jürgen Karl Keith Kenneth Kevin Klaus Larry Laurent Leon Louis Luca Lukas Luis Manuel Marco Mark Markus Martin Mathieu Matthew Matthias Michael Michel Miguel Mohamed Mohammed Muhammad Nathan Nicholas Nicolas Oliver Omar Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Rainer Rajesh Ralph Ramón Raymond Richard Robert Roberto Roger Roland Ronald Samuel Scott Sebastian Sergio Simon Stefan Stephen Steven Thierry Thomas Timothy Tobias Ulrich Uwe Victor Vincent Walter Werner William Wolfgang Xavier Yusuf".split(),
    ("cyrillic", "f"): "Алина Александра Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Зоя Ирина Ксения Лариса Людмила Мария Марина Надежда Наталия Наталья Нина Оксана Ольга Полина Светлана София Тамара Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Владимир Вячеслав Геннадий Георгий Григорий Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Максим Михаил Никита Николай Олег Павел Пётр Роман Сергей Степан Фёдор Юрий Ярослав".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ιωάννα Κατερίνα Κωνσταντίνα Μαρία Παναγιώτα Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Αντώνης Βασίλειος Βασίλης Γεώργιος Γιάννης Γιώργος Δημήτρης Δημήτριος Ιωάννης Κωνσταντίνος Κώστας Μιχαήλ Νικόλαος Νίκος Παναγιώτης Σπύρος Χρήστος".split(),
    ("arabic", "f"): "فاطمة عائشة مريم زينب خديجة ليلى سارة نور هدى سلمى".split(),
    ("arabic", "m"): "محمد أحمد علي حسن حسين خالد عمر يوسف إبراهيم محمود".split(),
    ("devanagari", "f"): "प्रिया सीता गीता अनीता सुनीता कविता पूजा नेहा मीना राधा".split(),
    ("devanagari", "m"): "राम मोहन राजेश सुरेश अमित विजय संजय रमेश राहुल अर्जुन".split(),
}
_OF = {n: kind for kind, names in NAMES.items() for n in names}
# (?<!\w) doesn't see the vowel signs of Devanagari, which are no word characters
_SURNAME = {"latin": rf"(?:(?:van|von|der|den|de|la|del|da|di|Mc|Mac|O['’]) ?)*[{_LATIN_UP}][{_LATIN}]+(?:-[{_LATIN_UP}][{_LATIN}]+)?", "cyrillic": r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?", "greek": r"[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ]+", "arabic": r"(?:ال)?[ء-ي]{3,}", "devanagari": r"[ऀ-ॣ]{2,}"}


def _listed(script: str, shape=lambda n: n) -> str:
    return "|".join(sorted((shape(n) for (t, _), names in NAMES.items() if t == script for n in names), key=len, reverse=True))


#: First name (with a second one, a patronymic or an initial, perhaps), then surname.
_FULL = {s: re.compile(rf"(?<![\wऀ-ॿ])({_listed(s)})((?: (?:[{_LATIN_UP}]\.|{_listed(s)})){{0,2}}|(?: [А-ЯЁ][а-яё]+(?:вич|вна|чна))?) ({pattern})(?![\wऀ-ॿ])") for s, pattern in _SURNAME.items()}
_CAPITALS = re.compile(rf"(?<!\w)({_listed('latin', str.upper)})(?: [{_LATIN_UP}]\.)? ([{_LATIN_UP}]{{2,}}(?:-[{_LATIN_UP}]{{2,}})?)(?!\w)")
_REVERSED = re.compile(rf"(?<!\w)([{_LATIN_UP}][{_LATIN}]+(?:-[{_LATIN_UP}][{_LATIN}]+)?), ({_listed('latin')})(?!\w)")
_PATRONYMIC = re.compile(r"(?<!\w)([А-ЯЁ][а-яё]+) ([А-ЯЁ][а-яё]+(?:ович|евич|овна|евна))(?: ([А-ЯЁ][а-яё]+))?(?!\w)")
_MEN, _WOMEN = "Mr Herr Herrn Señor Monsieur", "Mrs Ms Miss Frau Señora Señorita Madame Mademoiselle Mme Mlle"
#: A title, then a surname with a first name before it perhaps.
_TITLE = re.compile(rf"(?<!\w)({'|'.join((_MEN + ' ' + _WOMEN + ' Mx Dr Prof').split())})\.? (?:(?:Dr|Prof)\.? )*(?:([{_LATIN_UP}][{_LATIN}]+) (?:[{_LATIN_UP}]\. )?)?({_SURNAME['latin']})(?!\w)")
#: Words that introduce a name of two parts.
_SAID = re.compile(rf"(?:(?i:my name is|i am called|full name:|name:|signed by:?|sincerely,|best regards,|kind regards,|attn:?|mein name ist|ich heiße|mit freundlichen grüßen,?|je m['’]appelle|mon nom est|nom:|cordialement,|me llamo|mi nombre es|nombre:|atentamente,))\s+([{_LATIN_UP}][{_LATIN}]+) (?:[{_LATIN_UP}]\. )?({_SURNAME['latin']})(?!\w)")
_INTRODUCED = frozenset(w for x in "name called signed sincerely regards attn heiße grüßen appelle nom cordialement llamo nombre atentamente".split() for w in (x, x.title(), x.upper()))
_FAMILIES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN = re.compile(rf"(?:(?<=姓名：)|(?<=姓名:)|(?<=我叫))([{_FAMILIES}])([一-龥]{{1,2}})(?![一-龥])|([{_FAMILIES}])([一-龥]{{1,2}})(?=先生|女士|小姐|教授|医生)")
_FIRST = frozenset(_OF) | frozenset(n.upper() for n in _OF)
_TITLES = frozenset((_MEN + " " + _WOMEN + " Mx Dr Prof").split())
_ENDINGS = {("cyrillic", "f"): ("овна", "евна", "ская", "ова", "ева", "ина", "ая"), ("cyrillic", "m"): ("ович", "евич", "ский", "ов", "ев", "ин", "ый"), ("greek", "f"): ("ου",), ("greek", "m"): ("ος", "ης", "ας")}


def _iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and 2 <= int(s[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _kind(first: str | None, gender: str = "u", script: str = "latin") -> str:
    return ":".join(_OF.get(_titled(first), (script, gender))) if first else f"{script}:{gender}"


def _titled(name: str) -> str:
    return name[:1].upper() + name[1:].lower()


def _names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of first names (first:script:gender) and surnames (last:script:gender)."""
    found: list[tuple[int, int, str]] = []

    def add(m: re.Match, first: int, last: int, kind: str) -> None:
        for group, what in ((first, "first"), (last, "last")):
            if group and m[group]:
                found.append((*m.span(group), f"{what}:{kind}"))

    words = set(_WORD.findall(text))
    if not _FIRST.isdisjoint(words) or re.search("[ऀ-ॿ]", text):
        for pattern in _FULL.values():
            for m in pattern.finditer(text):
                add(m, 1, 3, _kind(m[1]))
                for w in re.finditer(r"\w{2,}", m[2]):
                    at = m.start(2) + w.start()
                    found.append((at, at + len(w[0]), f"{'first' if w[0] in _OF else 'last'}:{_kind(m[1])}"))
        for m in _CAPITALS.finditer(text):
            add(m, 1, 2, _kind(m[1]))
        for m in _REVERSED.finditer(text):
            add(m, 2, 1, _kind(m[2]))
    if not _TITLES.isdisjoint(words):
        for m in _TITLE.finditer(text):
            add(m, 2, 3, _kind(m[2], "m" if m[1] in _MEN.split() else "f" if m[1] in _WOMEN.split() else "u"))
    if not _INTRODUCED.isdisjoint(words):
        for m in _SAID.finditer(text):
            add(m, 1, 2, _kind(m[1]))
    if "вич" in text or "вна" in text:
        for m in _PATRONYMIC.finditer(text):
            kind = _kind(m[1], "m" if m[2].endswith("ч") else "f", "cyrillic")
            add(m, 1, 3, kind)
            found.append((*m.span(2), f"last:{kind}"))
    if any(x in text for x in ("先生", "女士", "小姐", "教授", "医生", "姓名", "我叫")):
        for m in _HAN.finditer(text):
            add(m, 2, 1, "han:u") if m[1] else add(m, 4, 3, "han:u")
    if found:
        known: dict[str, str] = {}
        for a, b, kind in found:
            if not kind.startswith("first:han") and not kind.startswith("last:han"):
                known.setdefault(text[a:b], kind)
        if known:
            for m in re.finditer(rf"(?<![\w\-ऀ-ॿ])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w\-ऀ-ॿ])", text):
                found.append((*m.span(), known[m[0]]))
    return found


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlaps.  Names are given as their parts: first name
    (first:script:gender) and surname (last:script:gender)."""
    if not text:
        return []
    found = _names(text)
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("card", _CARD), ("phone", _PHONE), ("ip", _IP), ("ssn", _SSN)):
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
        found += [(*m.span(), "iban") for m in _IBAN.finditer(text) if _iban_valid(m[0])]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


# --- surrogates

_SETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñ", "ýÿœæøßð", "āăąćčďđēęěğģīįķļłńňņōőřśşšťţūůűųźżž", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "0123456789", "".join(map(chr, range(0x621, 0x63B))) + "".join(map(chr, range(0x641, 0x64B))), "".join(map(chr, range(0x905, 0x915))), "".join(map(chr, range(0x915, 0x93A))), "".join(map(chr, range(0x93E, 0x94D))), _FAMILIES]
_ALPHABET: dict[str, str] = {c: s for s in _SETS for c in s}
_HAN_ALL = "".join(map(chr, range(0x4E00, 0x9FA6)))


def _cased(new: str, old: str) -> str:
    """new, in lower case, with the capitals of old."""
    if len(new) == len(old):
        return "".join(n.upper() if o != o.lower() and len(n.upper()) == 1 else n for n, o in zip(new, old))
    return new.upper() if len(old) > 1 and old == old.upper() != old.lower() else new[:1].upper() + new[1:]


class Surrogates:
    """Keyed permutations of the forms of entities."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.memo = Memo(lambda e: self._replaced(*e), 200_000)

    def _number(self, *parts) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=self.key, digest_size=16).digest(), "big")

    def _feistel(self, x: int, size: int, tweak: str, back: bool) -> int:
        """A keyed permutation of 0 .. size - 1: a Feistel network over the next power of four, walked until within."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(7, -1, -1) if back else range(8):
                if back:
                    a, b = b ^ (self._number("f", tweak, size, r, a) & mask), a
                else:
                    a, b = b, a ^ (self._number("f", tweak, size, r, b) & mask)
            x = a << half | b
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of 0 .. size - 1 that fixes nothing (if size > 1), or its inverse."""
        if size < 2:
            return x
        k = 1 + self._number("k", tweak, size) % (size - 1)
        return self._feistel((self._feistel(x, size, tweak, True) + (-k if back else k)) % size, size, tweak, False)

    def pattern(self, text: str, tweak: str, back: bool = False, sets: list[str] | None = None) -> str:
        """Each character replaced by one of its set, all of them together by one permutation."""
        sets = sets or [_ALPHABET.get(c, c) for c in text]
        size, x = 1, 0
        for c, s in zip(text, sets):
            size, x = size * len(s), x * len(s) + s.index(c)
        x = self.moved(x, size, "|".join([tweak, *(f"{s[0]}{len(s)}" for s in sets)]), back)
        out = []
        for s in reversed(sets):
            x, r = divmod(x, len(s))
            out.append(s[r])
        return "".join(reversed(out))

    # The entity without its spelling, its surrogate (or, back, what it is the surrogate of), and the surrogate spelt as the entity.

    def _email(self, text: str, tweak: str, back: bool) -> str:
        local, _, domain = text.rpartition("@")
        name, dot, top = domain.rpartition(".")
        new = self.pattern(name, f"{tweak}domain.{top}", back)
        return f"{self.pattern(local, f'{tweak}local@{name if not back else new}.{top}', back)}@{new}{dot}{top}"

    def _phone(self, text: str, tweak: str, back: bool) -> str:
        sets = ["0123456789"] * len(text)
        sets[0] = "01" if text[0] in "01" else "23456789"
        return self.pattern(text, tweak + "phone", back, sets)

    def _ssn(self, text: str, tweak: str, back: bool) -> str:
        return self.pattern(text, tweak + "ssn", back)

    def _ip(self, text: str, tweak: str, back: bool) -> str:
        octets = list(map(int, text.split(".")))
        low, n = (1, 223) if 1 <= octets[0] <= 223 else (224, 32) if octets[0] else (0, 1)
        x = self.moved(((octets[0] - low) << 24) | octets[1] << 16 | octets[2] << 8 | octets[3], n << 24, f"{tweak}ip{low}", back)
        return f"{low + (x >> 24)}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"

    @staticmethod
    def _luhn(digits: str) -> int:
        """The check digit that digits lack."""
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return -total % 10

    def _card(self, digits: str, tweak: str, back: bool) -> str:
        off = (int(digits[-1]) - self._luhn(digits[:-1])) % 10
        body = digits[0] + self.pattern(digits[1:-1], f"{tweak}card{digits[0]}", back)
        return body + str((self._luhn(body) + off) % 10)

    def _iban(self, s: str, tweak: str, back: bool) -> str:
        sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s[4:]]
        body = self.pattern(s[4:], tweak + "iban" + s[:2], back, sets)
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        return f"{s[:2]}{check:02d}{body}"

    def _first(self, text: str, tweak: str, back: bool, kind: str) -> str:
        kind = ":".join(_OF.get(_titled(text), kind.split(":")))
        script, gender = kind.split(":")
        if script == "han":
            return self.pattern(text, tweak + "given", back, [_HAN_ALL] * len(text))
        names = [n.lower() for n in NAMES.get((script, gender), ())]
        if text in names:
            return names[self.moved(names.index(text), len(names), tweak + "first" + kind, back)]
        # other names change among themselves: the permutation of letters is followed past all that are listed
        new = self.pattern(text, f"{tweak}first{script}", back)
        while new in _LOWER and new != text:
            new = self.pattern(new, f"{tweak}first{script}", back)
        return new

    def _last(self, text: str, tweak: str, back: bool, kind: str) -> str:
        script, gender = kind.split(":")
        ending = next((e for e in _ENDINGS.get((script, gender), ()) if text.endswith(e) and len(text) > len(e) + 1), "")
        stem = text[: len(text) - len(ending)]
        # of a compound surname, each part by itself, as it may stand alone elsewhere
        return "".join(p if p in _PARTICLES else self.pattern(p, f"{tweak}last{script}{ending}", back) for p in re.split(r"([ \-'’])", stem)) + ending

    def _replaced(self, kind: str, text: str) -> str:
        """The surrogate, in the spelling of the entity."""
        name, _, rest = kind.partition(":")
        swap = getattr(self, "_" + name)
        more = (rest,) if rest else ()
        plain, spell = _plain(name, text)
        # led back, a surrogate gives its entity, so that no other entity has it; else another key is tried
        for tweak in ("", *map(str, range(1, 100))):
            new = swap(plain, tweak, False, *more)
            if swap(new, tweak, True, *more) == plain:
                return spell(new)
        raise ValueError("no surrogate leads back to its entity")

    def replace(self, text: str | None) -> tuple[str | None, int]:
        found = entities(text)
        if not found:
            return text, 0
        out, at = [], 0
        for a, b, kind in found:
            out += [text[at:a], self.memo[kind, text[a:b]]]
            at = b
        return "".join(out) + text[at:], len(found)


_LOWER = frozenset(n.lower() for n in _OF)
_PARTICLES = frozenset(["", " ", "-", "'", "’", *"van von der den de la del da di mc mac o".split()])
#: Country codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _plain(name: str, text: str):
    """The entity without its spelling, and what spells a surrogate of it like the text."""
    if name in ("phone", "ssn", "card"):
        digits, kept = "".join(c for c in text if c in "0123456789"), 0
        if name == "phone" and text[0] == "+":
            kept = next((k for k in (1, 2) if digits[:k] in _CODES), 3)
        elif name == "phone" and digits[0] == "0":
            kept = 1  # the trunk prefix

        def spell(new: str) -> str:
            rest = iter(digits[:kept] + new)
            return "".join(next(rest) if c in "0123456789" else c for c in text)

        return digits[kept:], spell
    if name == "iban":

        def spell(new: str) -> str:
            rest = iter(new)
            return "".join(c if c == " " else next(rest) for c in text)

        return text.replace(" ", ""), spell
    return text if name == "ip" else text.lower(), (lambda new: new) if name == "ip" else lambda new: _cased(new, text)


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (doc_id, text, n_entities): every document, with surrogates for its entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for part in slices(batches):
            rows = [s.replace(x) for x in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["doc_id", "text", "n_entities"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_entities int")


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (kind, surrogate, n_entities) of the surrogates that several entities of the corpus share, spelling aside: none, if all is
    well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for part in slices(batches):
            found = {(name, _plain(name, x[a:b])[0], _plain(name, s.memo[kind, x[a:b]])[0]) for x in part["text"] for a, b, kind in entities(x) for name in [kind.partition(":")[0]]}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], ["kind", "entity", "surrogate"])

    met = lean(docs).select("text").mapInArrow(run, "kind string, entity string, surrogate string")
    return met.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n_entities")).where("n_entities > 1")
