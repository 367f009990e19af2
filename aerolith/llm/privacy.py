"""Personal information in free text: a semi-Markov conditional random field over segments of text.

A labelling cuts a text into segments: emails (also disguised), phone numbers, national person numbers, street addresses, person names, and the text between. Its score is
the sum of the segments' scores, each from features of the whole segment (its words in their places, its shape, check digits, how the number is grouped, what stands
before and after), and of transitions between neighbouring segments (both types and what separates them). Names are scored in every extent of every run of
capitalised words, so where a name begins and ends is a choice of the model; numbers, addresses and emails in every extent that the grammar of their formats allows.
Segments are bounded, so dynamic programming finds the best labelling, boundaries and types together. The weights maximise the conditional likelihood (forward and backward
sums over the same lattice) of sentences that ``privacy_training`` composes.

What is known of words comes from three places: a list of common first names, a list of words for places, institutions and instruments, and the vocabulary of a public tokenizer,
which tells whether a word is common, and common without its capital.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: A public vocabulary of many languages; where the file is absent, no word is known to be common.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MOST_BYTES = 64 << 20
#: Words in a name, and characters between two segments that count as neighbours.
LONGEST_NAME, NEIGHBOURS = 6, 3

# Common first names of western Europe.
GIVEN = frozenset(
    "adam adele agnes alain albert alejandro alessandro alex alexander alexandra alexandre alice amelie ana andre andrea andreas angela anna anne antoine antonio arthur aurelie "
    "barbara beatrice ben benjamin bernard brigitte bruno camille carla carlos carmen caroline cecile charles charlotte chiara christian christine christophe claire claude clara "
    "cristina daniel david denis diana diego dominique eduardo edward elena elizabeth emily emma enrique eric erik eva federico felix fernando florian francesca francesco francisco "
    "francois frank franz fred gabriel georg george giorgio giovanni giulia guillaume gunter hans heinz helen helene henri henry hugo ines irene isabel isabelle jack jacques james jan "
    "jane javier jean jennifer joao joel johannes john jonas jorge jose joseph juan julia julie julien jurgen karen karin karl katharina katrin kevin klaus laura lea leo linda lisa "
    "louis louise luca lucas lucia lucie luis luisa lukas manuel marc marco margaret maria marie mario mark markus marta martin martina mary matthew maurice max michael michel miguel "
    "monica monika nathalie nicolas nicole nina olivia olivier oscar pablo paola patricia patrick paul pedro peter petra philippe pierre rachel raul renate richard robert roberto sabine samuel".split()
)
TOP_LEVEL = frozenset("com org net edu gov int info biz eu fr de es it pt uk ch be nl at ie us ca io example invalid test".split())
#: Words after which a proper name names a place, an institution or a thing, and words that are no part of a person's name.
GENERIC = frozenset(
    "rue avenue boulevard bd place square allee impasse chemin quai route cours passage sentier esplanade promenade salle ecole college lycee groupe scolaire gymnase stade parc jardin pont tour residence "
    "hopital clinique eglise chapelle mairie gare port marche halle halles theatre musee bibliotheque mediatheque centre maison villa cite quartier lotissement zone station lac riviere col mont vallee foret "
    "universite institut laboratoire societe association fondation service direction commune ville departement street road lane court drive way terrace hall school building house park garden bridge church "
    "cathedral hospital college university institute library museum theatre station airport hill river lake valley tower square market centre center district county city town council department office "
    "company foundation trust strasse platz weg allee gasse schule halle saal kirche bahnhof brucke schloss haus turm berg tal amt stadt gemeinde universitat institut verein calle plaza avenida paseo "
    "camino escuela colegio instituto puente parque iglesia hospital barrio ciudad via piazza viale corso scuola ponte parco rua largo praca escola ponte sonde capteur sensor anemometre pluviometre balise "
    "probe logger model modele modell fuhler messgerat anemometer thermometer saint sainte san santa st biblioteca teatro museo stiftung academy gymnasium halls maternelle elementaire polyvalente".split()
)
CALENDAR = frozenset(
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre lundi mardi mercredi jeudi vendredi samedi dimanche january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday januar februar marz juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag enero "
    "febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miercoles jueves viernes sabado domingo".split()
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Dr|Prof|Professor|Professeur|Monsieur|Madame|Mademoiselle|Herr|Herrn|Frau|Sr|Sra|Srta|Señor|Señora|Don|Doña|Sig|Signor|Signora|Dott|Sir|Lady|Maître|Docteur|MM|Mmes)"
_CAP = r"(?:\p{Lu}[\p{L}\p{M}'’]*(?:-\p{Lu}[\p{L}\p{M}'’]*)*)"
#: Letters of the Latin script, for the patterns that go over whole texts.
_LU = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in [*range(0x100, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isupper())
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ̀-ͯ"
_LATIN = rf"(?:[{_LU}][{_LETTER}'’]*(?:-[{_LU}][{_LETTER}'’]*)*)"
_PART = r"(?:(?:[Dd]e la|DE LA|[Dd]e los|[Dd]e|DE|[Dd]u|DU|[Dd]el|DEL|[Vv]on der|[Vv]on|VON|[Vv]an der|[Vv]an den|[Vv]an|VAN|[Ll]e|LE|[Ll]a|LA|[Nn][íi]|N[ÍI]|[Mm]ac|[Dd]i|DI|[Dd]a|DA|[Dd]os|DOS|[Dd]ella|[Zz]u|ZU|[Tt]er|y|e|i) )"
_SP = r"[   ]"

_AT = rf"(?:{_SP}?@{_SP}?|{_SP}?[\(\[\{{](?:at|arobase|arroba|chiocciola|ät)[\)\]\}}]{_SP}?|{_SP}(?:at|arobase|arroba|chiocciola){_SP})"
_DOT = rf"(?:\.|{_SP}?[\(\[\{{](?:dot|point|punto|punkt|ponto)[\)\]\}}]{_SP}?|{_SP}(?:dot|point|punto|punkt|ponto){_SP})"
_EMAIL = regex.compile(rf"(?i)(?<![\w.+\-@])[\p{{L}}\d][\w.+\-]*{_AT}[\p{{L}}\d][\p{{L}}\d\-]*(?:{_DOT}[\p{{L}}\d\-]+)*{_DOT}\p{{L}}{{2,}}(?![\w@])")
_AT_MARKED = re.compile(r"[(\[{](?:at|AT|At|arobase|AROBASE|arroba|ARROBA|chiocciola|ät)[)\]}]")
_AT_WORDS = (" at ", " AT ", " arobase ", " arroba ", " chiocciola ")
#: After a bare word for the sign only what may be a host.
_HOST = re.compile(r"[\w\-]+(?:\.[A-Za-z]{2}|(?:\.[\w\-]+)+|[ ]?[(\[{]?(?:dot|point|punto|punkt|ponto|DOT|POINT|PUNTO)\b| (?:dot|point|punto|punkt|ponto|DOT) )")

_S = r"([ .\-  ‑]?)"
_PHONES = {
    "fr": rf"0[1-9]{_S}\d\d(?:\1\d\d){{3}}",
    "fr+": rf"(?:\+33|0033){_S}(?:\(0\){_S})?[1-9]{_S}\d\d(?:\3\d\d){{3}}",
    "uk": r"07\d{3}[ \-]?\d{3}[ \-]?\d{3}|0(?:2\d|1\d1|11\d)[ \-]\d{3,4}[ \-]\d{4}|01\d{3}[ \-]\d{5,6}|020\d{8}|\(0\d{2,4}\)[ ]?\d{3,4}[ ]?\d{4}",
    "uk+": r"(?:\+44|0044)[ \-]?(?:\(0\)[ \-]?)?\d{2,4}[ \-]?\d{3,4}[ \-]?\d{3,4}",
    "us": r"(?:\+?1[ .\-])?(?:\(\d{3}\)[ ]?|\d{3}[.\-])\d{3}[.\-]\d{4}",
    "de": r"\(0\d{2,4}\)[ ]?\d{4,8}(?:[ \-]\d{1,4})?|0\d{2,4}/\d{4,8}(?:-\d{1,4})?",
    "de+": r"(?:\+49|0049)[ \-]?(?:\(0\)[ \-]?)?\d{2,4}[ \-/]?\d{4,8}(?:[ \-]\d{1,4})?",
    "es+": r"(?:\+34|0034)[ .\-]?[6789]\d{2}(?:[ .\-]?\d{3}){2}|(?:\+34|0034)[ .\-]?[6789]\d{2}(?:[ .\-]?\d{2}){3}",
    "int+": r"\+\d{1,3}(?:[ .\-]?\d{1,4}){3,5}",
}
_PHONE = {k: regex.compile(rf"(?<![\w+])(?<!\d[ .,/\- ])(?:{v})(?!\d)") for k, v in _PHONES.items()}
_NIR = regex.compile(r"(?<!\d)[12]([ .\- ]?)\d\d\1\d\d\1(?:\d\d|2[AB])\1\d{3}\1\d{3}(?:(?:[ .\- ]?|[ ]?/[ ]?)\d\d)?(?!\d)")
_DNI = regex.compile(r"(?<![\w.])(?:\d{8}|\d\d\.\d{3}\.\d{3}|[XYZ]-?\d{7})[ \-]?[A-Z](?!\w)")
_SSN = regex.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_NINO = regex.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")
_TAX = regex.compile(r"(?<![\d+])(?:\d{2} \d{3} \d{3} \d{3}|\d{11})(?!\d)")
_FISCAL = re.compile(r"[A-Z]{6}(?<!\w.{6})\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?!\w)")
#: Six digits or more with little between them; formats of numbers are tried only there.
_RUN_OF_DIGITS = re.compile("\\d(?:[ .\\-/()   ‑]{0,3}(?:2[AB]|\\d)){5,}")

_NUM = r"\d{1,4}(?:(?:[ ]?(?i:bis|ter|quater)|[ ]?[A-Za-z])(?![\p{L}\d'’]))?"
_FR_TYPE = r"(?i:rue|avenue|av\.|impasse|chemin|place|quai|allée|boulevard|bd|route|cours|sentier|passage|esplanade|promenade|ruelle|voie)"
_FR_LINK = r"(?i:(?:de la|de l['’]|des|de|du|d['’]|aux|au|à la|à l['’]|la|le|les|l['’])[ ]?)"
_FR_NAME = rf"(?:{_FR_LINK}{{0,2}}(?:\d{{1,2}}-)?{_CAP}(?:[ -]{_FR_LINK}{{0,2}}{_CAP}){{0,3}})"
_TOWN = rf"(?:{_CAP}(?:-(?:(?i:sur|sous|en|la|le|les|lès|de|du|des|aux)|{_CAP}))*)"
_POST = rf"(?:,?[  ]|[ ]?[,–—-][ ]?|,?\n)(?:[A-Z]{{1,2}}-)?\d{{5}} {_TOWN}"
_DE_STREET = rf"(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|AM|AN DER|AN DEN|IM|IN DER|ZUM|ZUR|AUF DEM|AUF DER|UNTER DEN)(?: [\p{{L}}\-]+){{1,2}}|\p{{Lu}}[\p{{L}}\-]*(?i:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|steig|hof))"
_ES_STREET = rf"(?:(?i:c/|calle|avenida|avda\.|plaza|paseo|camino|travesía|via|viale|piazza|rua|largo) (?i:(?:de los|de las|de la|del|de|da|do|dos) )?{_CAP}(?: (?:de la |del |de )?{_CAP}){{0,2}})"
_EN_TYPE = r"(?i:Street|Road|Lane|Avenue|Close|Court|Drive|Way|Terrace|Crescent|Gardens|Grove|Hill|Square|Place|Row|Mews|St\.|Rd\.|Ave\.|Ct\.|Dr\.|Ln\.|St|Rd|Ave|Ct|Dr|Ln)"
_UK_POST = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_ADDRESSES = {
    "fr": (rf"{_NUM},?[ ]{_FR_TYPE} {_FR_NAME}", rf"{_POST}"),
    "de": (rf"{_DE_STREET} \d{{1,4}}[ ]?[a-z]?(?![\p{{L}}\d])", rf"{_POST}"),
    "es": (rf"{_ES_STREET},? (?:[nN][º°oO]\.? ?|núm\. ?)?\d{{1,4}}(?! ?%)(?![\d,.]\d)", rf"{_POST}"),
    "en": (rf"{_NUM} (?:S[tT]\. )?{_CAP}(?: {_CAP}){{0,2}} {_EN_TYPE}(?![\p{{L}}\d])", rf"(?:, {_TOWN}(?:,? {_UK_POST}|,? [A-Z]{{2}} \d{{5}})?|,? {_UK_POST})"),
}
_ADDRESS = {k: (regex.compile(rf"(?<![\p{{L}}\d]){a}"), regex.compile(b)) for k, (a, b) in _ADDRESSES.items()}

#: A number that a street follows, or that follows a street; the grammar is tried only there.
_STREET_TYPES = "rue avenue av. impasse chemin place quai allée boulevard bd route cours sentier passage esplanade promenade ruelle voie".split()
_HOUSE_FIRST = re.compile(rf"\d{{1,4}}(?:[ ]?(?:bis|ter|quater|BIS|TER|[A-Za-z]))?,?[ ](?=[{_LU}]|{'|'.join(re.escape(t) for t in _STREET_TYPES)})")
_HOUSE_LAST = re.compile(r"\d(?<=[A-Za-zÀ-ÿ.,º°] \d)\d{0,3}(?!\d)")
_STREET_ENDS = tuple(f"{t} " for t in "straße strasse str. gasse weg platz allee ufer ring damm steig hof".split())
_STREET_WORDS = ("am ", "an der ", "an den ", "im ", "in der ", "zum ", "zur ", "auf dem ", "auf der ", "unter den ", "c/", "calle ", "avenida ", "avda.", "plaza ", "paseo ", "camino ", "travesía ", "via ", "viale ", "piazza ", "rua ", "largo ")


def _street_before(left: str) -> bool:
    left = left.lower()
    return left.endswith(_STREET_ENDS) or any(w in left for w in _STREET_WORDS)


_INIT = rf"(?:[{_LU}]\.(?:[ \-]?[{_LU}]\.)?)"
_WORD = rf"(?:{_TITLE}\.|{_INIT}|{_LATIN})"
_END = rf"(?![{_LETTER}\d@_])"
#: Runs of two or more capitalised words, what may lead them, and those after a title without capital.
_DOTTED = "(?:" + "|".join(rf"(?<=\b{t})" for t in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Sra", "Srta", "Sig", "Dott")) + r")\."
_FIRST = rf"[{_LU}](?<![{_LETTER}\d@_.\-].)(?:\.(?:[ \-]?[{_LU}]\.)?|[{_LETTER}'’]*(?:-[{_LU}][{_LETTER}'’]*)*(?:{_DOTTED})?)"
_RUN = re.compile(rf"{_FIRST}(?:,?{_SP}{_PART}{{0,2}}{_WORD})+{_END}")
_LEAD = re.compile(rf"(?<![{_LETTER}]){_PART}{{1,2}}$")
_TITLED = re.compile(rf"[mdsfhpM](?<![{_LETTER}].)(?:(?<=m)(?:onsieur|adame|ademoiselle|me|lle|r|rs|aître)|(?<=d)(?:octeur|r|on|oña|ott)|(?<=s)(?:eñor|eñora|r|ra|ig|ignora?)|(?<=f)rau|(?<=h)errn?|(?<=p)(?:rof|rofesseur|rofessor))\.?{_SP}({_PART}{{0,2}}{_LATIN}(?:{_SP}{_PART}{{0,2}}{_LATIN})*){_END}")
_PIECE = re.compile(rf"{_TITLE}\.|{_INIT}|{_LATIN}|,|[{_LETTER}]+")
_IS_TITLE = re.compile(rf"(?i:{_TITLE})\.?|M\.")
_IS_INIT = re.compile(_INIT)

_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CLOSE = regex.compile(r"[\p{L}\p{M}'’]+|\d+|\n|[^\s]")


class Span(NamedTuple):
    """A segment that may be chosen; ``parts`` are (feature function, arguments)."""

    start: int
    end: int
    kind: str
    parts: tuple


@lru_cache(maxsize=1 << 16)
def plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


@lru_cache(maxsize=4)
def common_words(path: str = VOCABULARY) -> dict[str, int]:
    """What the vocabulary says of words (in lower case): 1 known with a capital, 2 without, 3 both and more often with one, 4 both and less often."""
    if not os.path.exists(path):
        return {}
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary of bounded size")
    rank: dict[str, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, number = line.split()
            try:
                word = base64.b64decode(token).decode()
            except UnicodeDecodeError:
                continue
            if word[:1] == " " and len(word) > 2 and word[1:].isalpha() and word[2:].islower():
                rank[word[1:]] = int(number)
    out: dict[str, int] = {}
    for word, r in rank.items():
        low = word.lower()
        cap, no = rank.get(low[0].upper() + low[1:]), rank.get(low)
        out[low] = 1 if no is None else 2 if cap is None else 3 if cap < no else 4
    return out


_words: dict[str, int] = {}


def know(common: dict[str, int]) -> None:
    """Let this process know the common words. (A worker gets this function by name; a table that the kernel itself names would be a copy.)"""
    _words.update(common)


# Feature functions: what a part of a segment says, from hashable arguments, so that its score is computed once and remembered.
def _token(role: str, token: str) -> list[str]:
    """A word of a name in its place: first, inner, last or only."""
    low = plain(token)
    parts = low.split("-")
    if _IS_INIT.fullmatch(token):
        return [f"w|{role}|initial", f"w|{role}|initial {low}"] if low == "m." else [f"w|{role}|initial"]
    upper = token.isupper() and len(token) > 1
    f = [f"w|{role}|" + ("upper" if upper else "mixed" if any(c.isupper() for c in token[1:].replace("-", "")) and len(parts) == 1 else "title")]
    f.append(f"w|{role}|known {_words.get(token.lower(), 0)}")
    f.append(f"w|{role}|given {'all' if all(p in GIVEN for p in parts) else 'first' if parts[0] in GIVEN else 'none'}")
    if low in GENERIC or parts[0] in GENERIC:
        f.append(f"w|{role}|generic")
    if low in CALENDAR:
        f.append(f"w|{role}|calendar")
    if len(parts) > 1:
        f.append(f"w|{role}|hyphen")
    if "'" in token or "’" in token:
        f.append(f"w|{role}|elided " + ("l" if low[0] in "ldcjnsqm" else "o"))
    f.append(f"w|{role}|letters {min(len(low), 7)}" + (" upper" if upper else ""))
    if not any(c in "aeiouy" for c in low):
        f.append(f"w|{role}|no vowel")
    return f + [f"w|{role}|ends {low[-3:]}", f"w|{role}|ends {low[-2:]}"]


def _shape(words: str, case: str, known: str, edge: str) -> list[str]:
    return ["n|bias", f"n|shape {words}", f"n|case {case}", f"n|known {known}", f"n|edge {edge}", f"n|known {known} {edge}"]


def _class(t: str) -> str:
    return "#" if t.isdigit() else "cap" if t[:1].isupper() else "low" if t[:1].isalpha() else "sign"


def _side(kind: str, side: str, near: str, far: str) -> list[str]:
    """The words beside a segment: the nearer one by itself and by class, both together."""
    a, b = ("#" if t.isdigit() else t.lower() for t in (near, far))
    f = [f"{kind}|{side} {a}", f"{kind}|{side} {a} {b}", f"{kind}|{side} is {_class(near)}"]
    if plain(near) in GENERIC or (side == "left" and plain(far) in GENERIC and len(near) <= 3):
        f.append(f"{kind}|{side} generic")
    if side == "left":
        if _IS_TITLE.fullmatch(near) or (near == "." and _IS_TITLE.fullmatch(far + ".")):
            f.append(f"{kind}|title before")
        if near in "^\n.!?:;•*":
            f.append(f"{kind}|sentence begins")
    return f


def _form(kind: str, *said: str) -> list[str]:
    return [f"{kind}|bias"] + [f"{kind}|{x}" for x in said]


def _nir_valid(digits: str) -> bool:
    body = digits[:13].replace("2A", "19").replace("2B", "18")
    return len(digits) == 15 and body.isdigit() and 97 - int(body) % 97 == int(digits[-2:])


def _dni_valid(s: str) -> bool:
    s = regex.sub(r"[ .\-]", "", s)
    n = s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
    return n.isdigit() and _DNI_LETTERS[int(n) % 23] == s[-1]


def _tax_valid(digits: str) -> bool:
    """The check digit of ISO 7064, mod 11, 10."""
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


class _Close:
    """The two words before and after each place of a text, found once."""

    def __init__(self, text: str):
        self.text, self.left, self.right = text, {}, {}

    def sides(self, kind: str, a: int, b: int) -> tuple:
        if a not in self.left:
            t = _CLOSE.findall(self.text[max(0, a - 40) : a])[-2:]
            self.left[a] = ["^"] * (2 - len(t)) + t
        if b not in self.right:
            t = _CLOSE.findall(self.text[b : b + 30])[:2]
            self.right[b] = t + ["$"] * (2 - len(t))
        (l2, l1), (r1, r2) = self.left[a], self.right[b]
        return (_side, (kind, "left", l1, l2)), (_side, (kind, "right", r1, r2))


def _names(text: str, close: _Close, out: dict) -> None:
    for pattern, group in ((_RUN, 0), (_TITLED, 1)):
        for run in pattern.finditer(text):
            base, end = run.span(group)
            if not group and text[base - 1 : base] == " " and (lead := _LEAD.search(text, max(0, base - 16), base)):
                base = lead.start()
            pieces = [(m.start(), m.end(), m[0]) for m in _PIECE.finditer(text, base, end)]
            big = [i for i, p in enumerate(pieces) if p[2][0].isupper()]
            single = [i for i in big if (group and i == big[0]) or (i and _IS_TITLE.fullmatch(pieces[i - 1][2]))]
            title = {i for i in big if _IS_TITLE.fullmatch(pieces[i][2]) and i + 1 < len(pieces)}
            for i in range(len(pieces)):
                lead = i
                while lead < len(pieces) and lead not in big:  # particles first
                    lead += 1
                if pieces[i][2] == "," or lead == len(pieces) or (lead > i and lead - i > 2):
                    continue
                for j in big:
                    if j < lead or j - i >= LONGEST_NAME + 2:
                        continue
                    inside = [k for k in big if lead <= k <= j]
                    if any(k in title for k in inside) or len(inside) > LONGEST_NAME:
                        break
                    if len(inside) == 1 and not (lead in single or i in single or (i and i - 1 in title)):
                        continue
                    a, b = pieces[i][0], pieces[j][1]
                    if (a, b, "name") in out:
                        continue
                    words = [pieces[k] for k in range(i, j + 1)]
                    n = len(inside)
                    parts, at, shape, case = [], 0, [], []
                    for _, _, w in words:
                        if w == ",":
                            shape.append(",")
                        elif not w[0].isupper() or (w.lower() in ("de", "la", "du", "le", "von", "van", "del", "di", "da") and at < n - 1 and w != words[-1][2]):
                            shape.append("p")
                            at += w[0].isupper()
                        else:
                            role = "only" if n == 1 else "first" if at == 0 else "last" if at == n - 1 else "inner"
                            parts.append((_token, (role, w)))
                            shape.append("I" if _IS_INIT.fullmatch(w) else "C")
                            if shape[-1] == "C":
                                case.append("U" if w.isupper() and len(w) > 1 else "t")
                            at += 1
                    caps = [w for _, _, w in words if w[0].isupper()]
                    low = [plain(w).split("-")[0] for w in caps]
                    known = ("G" if low[0] in GIVEN else "c" if _words.get(caps[0].lower(), 0) in (2, 4) else "x") + ("G" if low[-1] in GIVEN else "c" if _words.get(caps[-1].lower(), 0) in (2, 4) else "x")
                    edge = ("|" if i == 0 or pieces[i - 1][2] == "," else "-") + ("|" if j == len(pieces) - 1 or pieces[j + 1][2] == "," else "-")
                    parts.append((_shape, (" ".join(shape), "".join(case), known, edge)))
                    out[a, b, "name"] = (*parts, *close.sides("name", a, b))


def _numbers(text: str, close: _Close, out: dict) -> None:
    def add(a: int, b: int, kind: str, *said: str) -> None:
        if (a, b, kind) not in out:
            out[a, b, kind] = ((_form, (kind, *said)), *close.sides(kind, a, b))

    for run in _RUN_OF_DIGITS.finditer(text):
        a, b = max(0, run.start() - 4), min(len(text), run.end() + 4)
        for form, pattern in _PHONE.items():
            for m in pattern.finditer(text, a, b):
                digits = re.sub(r"\D", "", m[0])
                more = re.match(r"[ .\-/]?\d", text[m.end() : m.end() + 2])
                before = re.search(r"\d[ .\-/,]?$", text[max(0, m.start() - 2) : m.start()])
                kind_of = "solid" if m[0].isdigit() else "grouped"
                add(m.start(), m.end(), "phone", f"form {form}", f"form {form} {kind_of}", f"digits {len(digits)}", "goes on" if more or before else "alone", f"form {form} starts {digits[:2]}")
        for m in _NIR.finditer(text, a, b):
            s = regex.sub(r"[^\dAB]", "", m[0])
            month = int(s[3:5]) if s[3:5].isdigit() else 0
            add(m.start(), m.end(), "id_number", "nir", "nir " + ("valid" if _nir_valid(s) else "short" if len(s) == 13 else "invalid"), "nir month " + ("real" if 1 <= month <= 12 or 20 <= month <= 42 else "none"), "solid" if m[0].isdigit() else "grouped")
        for m in _DNI.finditer(text, a, b):
            add(m.start(), m.end(), "id_number", "dni", "dni " + ("valid" if _dni_valid(m[0]) else "invalid"))
        for m in _SSN.finditer(text, a, b):
            s = m[0]
            add(m.start(), m.end(), "id_number", "ssn", "ssn " + ("no area" if s[:3] in ("000", "666") or s[0] == "9" else "area"))
        for m in _NINO.finditer(text, a, b):
            add(m.start(), m.end(), "id_number", "nino", "nino " + ("unused prefix" if m[0][0] in "DFIQUV" or m[0][1] in "DFIQUVO" else "prefix"))
        for m in _TAX.finditer(text, a, b):
            s = m[0].replace(" ", "")
            add(m.start(), m.end(), "id_number", "tax", "tax " + ("grouped" if " " in m[0] else "solid"), "tax " + ("valid" if _tax_valid(s) else "invalid"))
    for m in _FISCAL.finditer(text):
        add(m.start(), m.end(), "id_number", "fiscal")


def _signs(text: str) -> Iterator[int]:
    """Places of what may be an email's sign."""
    at = text.find("@")
    while at >= 0:
        yield at
        at = text.find("@", at + 1)
    for m in _AT_MARKED.finditer(text):
        yield m.start()
    for word in _AT_WORDS:
        at = text.find(word)
        while at >= 0:
            if _HOST.match(text, at + len(word)):
                yield at
            at = text.find(word, at + 1)


def _emails(text: str, close: _Close, out: dict) -> None:
    for sign in _signs(text):
        a = max(0, sign - 80)
        for m in _EMAIL.finditer(text, a, min(len(text), sign + 140)):
            if m.span() + ("email",) in out or (m.start() == a and a and not text[a - 1].isspace()):
                continue
            s = m[0]
            top = s.replace("]", " ").replace(")", " ").replace("}", " ").replace(".", " ").split()[-1].lower()
            f = ["top known" if top in TOP_LEVEL else "top unknown"]
            if regex.fullmatch(r"[\w.+\-]+@[\w.\-]+", s):
                f.append("plain")
            else:
                words = bool(regex.search(r"(?i)[ (\[{](?:dot|point|punto|punkt|ponto)[ )\]}]", s))
                bare = bool(regex.search(r"(?i) (?:at|arobase|arroba|chiocciola) ", s))
                f += ["disguised", "disguised " + ("dot " if words else "") + ("bare" if bare else "marked"), ("top known " if top in TOP_LEVEL else "top unknown ") + ("bare" if bare else "marked")]
            if regex.search(r"(?:@|\]|\)| )\d", s):
                f.append("domain digit")
            if len(regex.match(r"[\w.+\-]+", s)[0]) == 1:
                f.append("local short")
            out[m.start(), m.end(), "email"] = ((_form, ("email", *f)), *close.sides("email", *m.span()))


def _addresses(text: str, close: _Close, out: dict) -> None:
    def add(form: str, m: regex.Match) -> None:
        s, e = m.span()
        if (s, e, "address") in out:
            return
        number = re.search(r"\d+", m[0])[0]
        f = [f"form {form}", f"number {min(len(number), 4)}", f"form {form} number {min(len(number), 4)}"]
        out[s, e, "address"] = ((_form, ("address", *f, "street only")), *close.sides("address", s, e))
        if t := _ADDRESS[form][1].match(text, e):
            out[s, t.end(), "address"] = ((_form, ("address", *f, "with town", f"form {form} with town")), *close.sides("address", s, t.end()))

    for house in _HOUSE_FIRST.finditer(text):
        for form in ("fr", "en"):
            if m := _ADDRESS[form][0].match(text, house.start()):
                add(form, m)
    for house in _HOUSE_LAST.finditer(text):
        a = max(0, house.start() - 60)
        if _street_before(text[a : house.start()]):
            for form in ("de", "es"):
                for m in _ADDRESS[form][0].finditer(text, a, min(len(text), house.end() + 4)):
                    add(form, m)


def candidates(text: str) -> list[Span]:
    """All segments of a text that may be chosen, by end and start."""
    out: dict[tuple[int, int, str], tuple] = {}
    close = _Close(text)
    _emails(text, close, out)
    _numbers(text, close, out)
    _addresses(text, close, out)
    _names(text, close, out)
    return [Span(a, b, k, parts) for (a, b, k), parts in sorted(out.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))]


def features(span: Span) -> list[str]:
    return [f for fn, args in span.parts for f in fn(*args)]


def transition(text: str, one: Span, two: Span) -> str:
    """The feature of two neighbouring segments: both types and what stands between them."""
    return f"t|{one.kind} {two.kind} {text[one.end : two.start]!r}"


class Scorer:
    """Scores of segments; those of a word in its place and of neighbours are remembered."""

    MOST = 1 << 20

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __call__(self, span: Span) -> float:
        total = 0.0
        for part in span.parts:
            s = self.known.get(part)
            if s is None:
                get = self.weights.get
                s = sum(get(f, 0.0) for f in part[0](*part[1]))
                if len(self.known) < self.MOST:
                    self.known[part] = s
            total += s
        return total


def best(text: str, spans: list[Span], score: Callable[[Span], float], weights: dict[str, float]) -> list[Span]:
    """The segmentation with the highest score. ``top[i]`` is the best of the first i segments; a segment's predecessor is any that ends before it, those within ``NEIGHBOURS`` characters with a transition."""
    ends = [s.end for s in spans]
    top, chosen = [0.0], [-1]  # of the first i segments: the best score, and its last segment
    own, before = [], []
    for i, s in enumerate(spans):
        far = bisect.bisect_left(ends, s.start - NEIGHBOURS, 0, i)
        value, link = top[far], chosen[far]
        for j in range(far, bisect.bisect_right(ends, s.start, 0, i)):
            v = own[j] + weights.get(transition(text, spans[j], s), 0.0)
            if v > value:
                value, link = v, j
        own.append(value + score(s))
        before.append(link)
        if own[i] > top[i]:
            top.append(own[i])
            chosen.append(i)
        else:
            top.append(top[i])
            chosen.append(chosen[i])
    out, i = [], chosen[-1]
    while i >= 0:
        out.append(spans[i])
        i = before[i]
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(text: str, spans: list[Span], scores: list[float], weights: dict[str, float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """P(segment), and P(both, and nothing between) of neighbours, by forward and backward sums over the lattice."""
    n = len(spans)
    ends = [s.end for s in spans]
    far = [bisect.bisect_left(ends, s.start - NEIGHBOURS, 0, i) for i, s in enumerate(spans)]
    near = [[(j, weights.get(transition(text, spans[j], s), 0.0)) for j in range(far[i], bisect.bisect_right(ends, s.start, 0, i))] for i, s in enumerate(spans)]
    # a[i]: all labellings that end with segment i; total[i]: those of the first i segments.
    a, total = [], [0.0]
    for i in range(n):
        z = total[far[i]]
        for j, t in near[i]:
            z = _log_add(z, a[j] + t)
        a.append(z + scores[i])
        total.append(_log_add(total[i], a[i]))
    # b[i]: all that may follow segment i.
    after: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(far[i]):
            after[j].append((i, 0.0))
        for j, t in near[i]:
            after[j].append((i, t))
    b = [0.0] * n
    for i in range(n - 1, -1, -1):
        for j, t in after[i]:
            b[i] = _log_add(b[i], t + scores[j] + b[j])
    z = total[n]
    pairs = {(j, i): math.exp(min(0.0, a[j] + t + scores[i] + b[i] - z)) for i in range(n) for j, t in near[i]}
    return [math.exp(min(0.0, a[i] + b[i] - z)) for i in range(n)], pairs


def fit(labelled: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 5, rate: float = 0.5, decay: float = 1e-3, vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood (adaptive steps, L2 penalty), the mean of those after each round but the first."""
    know(common_words(vocabulary))
    data = []
    for text, gold in labelled:
        spans = candidates(text)
        if spans:
            want = set(gold)
            data.append((text, spans, [features(s) for s in spans], [(s.start, s.end, s.kind) in want for s in spans]))
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1.0)
    total: dict[str, float] = defaultdict(float)
    for turn in range(rounds):
        for text, spans, fs, gold in data:
            scores = [sum(w[f] for f in x) for x in fs]
            single, pairs = marginals(text, spans, scores, w)
            g: dict[str, float] = defaultdict(float)
            for x, y, p in zip(fs, gold, single, strict=True):
                d = y - p
                if abs(d) > 1e-3:
                    for f in x:
                        g[f] += d
            for (j, i), p in pairs.items():
                d = (gold[j] and gold[i]) - p
                if abs(d) > 1e-3:
                    g[transition(text, spans[j], spans[i])] += d
            for f, d in g.items():
                d -= decay * w[f]
                seen[f] += d * d
                w[f] += rate * d / math.sqrt(seen[f])
        if turn:
            for f, v in w.items():
                total[f] += v / (rounds - 1)
    return {f: round(v, 4) for f, v in total.items() if abs(v) > 1e-2}


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """The fitted weights: the same on every run, as the training sentences come from a fixed seed."""
    from .privacy_training import sentences

    return fit(sentences())


def find(text: str | None, w: dict[str, float], score: Scorer | None = None) -> list[Span]:
    if not text:
        return []
    return best(text, candidates(text), score or Scorer(w), w)


_SHAPE = "row_id {0}, kinds array<string>, starts array<int>, ends array<int>, redacted string"


def detect(documents: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: ``row_id``, ``redacted`` (the text with ``[KIND]`` in place of each find, else unchanged) and arrays ``kinds``, ``starts``, ``ends`` of the finds in order.

    Places are code points, starts from 0, ends exclusive. Null and empty texts have no finds; a null stays null. Texts are read whole. Repeated rows come out as often; other columns are ignored.
    """
    w, common = weights(), common_words(vocabulary)
    kind = documents.schema[row_id].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know(common)
        score = Scorer(w)
        for b in batches:
            out: dict[str, list] = {"kinds": [], "starts": [], "ends": [], "redacted": []}
            for t in b.column("t").to_pylist():
                spans = find(t, w, score)
                out["kinds"].append([s.kind for s in spans])
                out["starts"].append([s.start for s in spans])
                out["ends"].append([s.end for s in spans])
                parts, at = [], 0
                for s in spans:
                    parts += [t[at : s.start], f"[{s.kind.upper()}]"]
                    at = s.end
                out["redacted"].append("".join([*parts, t[at:]]) if t is not None else None)
            i32 = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "kinds": pa.array(out["kinds"], pa.list_(pa.string())), "starts": pa.array(out["starts"], i32), "ends": pa.array(out["ends"], i32), "redacted": pa.array(out["redacted"], pa.string())})

    rows = documents.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(kernel, _SHAPE.format(kind)).withColumnRenamed("row_id", row_id)
