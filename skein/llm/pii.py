"""Problem 3: personal details in free text, found and replaced by typed placeholders.

Method: candidate gradient boosting. Generators of high recall propose spans of five types, overlapping ones
included. Boosted trees, one set a type, score each span by its format and its context; the trees are trained
here on texts that a generator writes of frames with known spans and look-alikes, calibrated on held-out texts, and cut
at the threshold of the best F1. Of overlapping spans the likeliest stays.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.boosting import Trees, best_threshold, calibrated, fit
from skein.llm.tokens import vocabulary_path
from skein.session import spread

TYPES = ("name", "email", "phone", "id_number", "address")
#: Texts written for training, and of these the part that is held out; this bounds the training rows.
TEXTS, HELD_OUT = 16_000, 0.25
#: The fitted trees, kept beside the code.
MODEL = Path(__file__).with_name("pii_model.json")

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽȘȚ"
LOW = "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžșț"
CAP = rf"(?:Mc|Mac|De|Di|Du|Le|La|Van|Fitz)?[{UP}][{LOW}]+(?:[-’'][{UP}]?[{LOW}]+)*|[{UP}][’'][{UP}][{LOW}]+"
PARTICLE = r"(?:de la|van der|van den|von der|de|del|della|di|da|dos|du|des|van|von|zu|le|la|den|der|ten|ter|bin|ibn|ben|al|el|af|av|st\.?)"
INITIAL = rf"[{UP}]\."
NAMES = re.compile(rf"(?=[{UP}])(?<![\w@/.-])(?:{CAP}|[{UP}]{{2,}}(?:-[{UP}]{{2,}})*)(?![\w@/]|-\d)(?:(?: {INITIAL}|,? {PARTICLE}(?= [{UP}])|,? (?:{CAP}|[{UP}]{{2,}}(?:-[{UP}]{{2,}})*)(?![\w@/]|-\d))){{1,7}}")
NAME_TOKEN = re.compile(rf"{PARTICLE}(?= )|{INITIAL}|[{UP}{LOW}][{UP}{LOW}’'-]*|,")

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%'-]+@[A-Za-z0-9](?:[\w-]*\w)?(?:\.[A-Za-z0-9][\w-]*)+", re.A)
_AT, _DOT = r"(?:\s?[\[({<]\s?(?:at|AT|arobase|chez|ät)\s?[\])}>]\s?| (?:at|AT|arobase) |\s@\s)", r"(?:\s?[\[({<]\s?(?:dot|DOT|point|punkt)\s?[\])}>]\s?| (?:dot|DOT|point) |\.)"
EMAIL_WRITTEN = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w+-]*(?:{_DOT}[\w+-]+)*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+", re.A)

PHONE = re.compile(
    r"(?<![\w.@/=-])(?:(?:(?:\+|00)\d{1,3}[ .\-])?\d(?:[ .\-]\d{2}){4}|(?:\+|00)\d{1,3}[ .\-]\d(?:[ .\-]\d{2,4}){2,5}|(?:\+|00)\d{8,15}|(?:(?:\+|00)\d{1,3}[ .\-/]?)?(?:\(0?\d{1,5}\)[ .\-/]?)?\d{2,5}(?:[ .\-/]\d{2,8}){0,5})(?![\w@])"
)
DATE = re.compile(r"(?:19|20)\d\d([-./])(?:0\d|1[0-2])\1[0-3]\d(?!\d)|[0-3]?\d([-./])(?:0?\d|1[0-2])\2(?:19|20)\d\d(?!\d)")

ID = re.compile(
    r"(?=[A-Z]{0,6}[ -]?\d)(?<![\w.+@/-])(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2}\d{6}[A-D]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[12378] \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?|[12378]\d{4}2[AB]\d{6}(?:\d{2})?|\d{2} \d{3} \d{3} \d{3,4}|[A-Z]{1,2} ?\d{6,8}[A-Z]?\d?"
    r"|\d{2}[- ]\d{4}[- ]\d{4}[- ][A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}-\d{3}-\d{3}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z0-9]{2}\d{2}[A-Z]\d{6}|\d{6}[-+]\d{4}|\d{9,15}|[A-Z]\d{8}|\d{2}[A-Z]{2}\d{5})(?![\w@/]|-\d|\.\d)"
)

_STREET = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|terrace|boulevard|blvd|way|court|ct|crescent|square|sq|place|pl|row|hill|gardens|grove|parkway|pkwy|walk|mews|alley|circle|quay|rise|view|highway|hwy"
_RUE = "rue|avenue|av\\.|boulevard|bd|place|impasse|chemin|allée|allees|allées|quai|cours|route|passage|square|sentier|ruelle|villa|cité|faubourg|esplanade"
_STRASSE = "straße|strasse|str\\.|weg|platz|allee|gasse|ring|ufer|damm|steig|pfad|hof|graben|chaussee|markt"
_UNIT = rf"(?:,? (?:[Aa]pt|[Aa]partment|[Uu]nit|[Ss]uite|[Ff]lat|[Rr]oom|[Ff]loor|[Ss]te|[Aa]ppt|[Aa]ppartement|[Bb]ât|[Bb]âtiment|[Ee]scalier|[Éé]tage|[Ww]ohnung|[Ww]hg|[Ww]hg\.|[Aa]pp)\.? ?#?\w{{1,5}}|,? #\w{{1,5}})?"
ADDRESS_EN = re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:[{UP}][\w’'.-]* ){{1,4}}(?i:{_STREET})\b\.?(?! ?[{UP}][{LOW}]+ (?i:{_STREET})\b)")
ADDRESS_FR = re.compile(rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-dA-D]))?,? (?i:{_RUE}) (?:(?:de la|de l[’']|des|du|de|d[’']|la|le|les|l[’'])? ?)?[{UP}][\w’'-]*(?:(?: (?:de la|des|du|de|et|à la|aux?|en|sur|la|le)| (?:de )?l[’'])? ?[{UP}][\w’'-]*){{0,4}}")
#: What is worth a look at the costlier patterns: what every match of theirs holds.
DIGITS = re.compile(r"(?<![\w.@/=-])[+(]?\d[\d .\-/()]{5,}\d")
IDS = re.compile(r"\d")
WRITTEN = re.compile(r"[\[({<]\s?(?:at|AT|arobase|chez|ät)\s?[\])}>]| (?:at|AT|arobase) |\s@\s")
GERMAN_ENDS = {p: re.compile(re.escape(p) + r" ?\d") for p in _STRASSE.replace("\\", "").split("|")}
GERMAN_PLACE = re.compile(rf"\b(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der|Vor dem) [{UP}][^\n\d]{{2,40}} \d")
ADDRESS_DE = re.compile(rf"(?<![\w-])(?:(?:[{UP}][\w’'-]*[ -]){{0,3}}[{UP}][\w’'-]*(?:{_STRASSE})|(?:[{UP}][\w’'-]* ){{0,3}}(?i:{_STRASSE})|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der|Vor dem) (?:[{UP}][\w’'-]* ?){{1,2}}) ?\d{{1,4}} ?[a-zA-Z]?\b(?!\.?\d)")
UNIT = re.compile(_UNIT.replace("{{", "{").replace("}}", "}"))

# Fixed values, authored for this module: words that tell what stands beside them.
FIRST = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra"
    " jean marie pierre michel andré philippe nathalie isabelle alain jacques catherine martine nicolas julien céline sophie laurent camille léa manon chloé hugo louis jules lucas"
    " peter michael wolfgang klaus jürgen dieter ursula monika petra sabine stefan andreas thomas anna lena leon paul felix hans karl heinz"
    " carlos maría josé juan luis ana carmen antonio francisco giuseppe giovanni marco luca giulia francesca jan piotr anna katarzyna olga ivan dmitri sergei natalia mehmet fatma ali mohamed ahmed fatima yusuf omar aisha"
    " wei li ming hiroshi yuki kenji priya rahul amit sunita anil min-jun ji-woo thi van kwame amara chidi lars erik ingrid nils astrid sven elena".split()
)
FAMILY = frozenset(
    "smith johnson williams brown jones garcia miller davis wilson anderson taylor thomas moore martin jackson thompson white harris clark lewis robinson walker young allen king wright scott hill green adams baker nelson"
    " bernard dubois durand leroy moreau laurent simon lefebvre michel roux fournier girard bonnet dupont lambert fontaine rousseau vincent müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann"
    " koch bauer richter klein wolf neumann schwarz zimmermann braun krüger hofmann lange rodríguez martínez hernández lópez gonzález pérez sánchez rossi russo ferrari esposito bianchi romano colombo nowak kowalski"
    " ivanov petrov novak horvat jensen hansen larsen andersson nilsson virtanen yilmaz kaya khan singh kumar patel sharma nguyen tran wang zhang chen liu kim lee park tanaka suzuki sato okafor mensah silva santos costa".split()
)
#: Places and kinds of places, which are written like names.
PLACES = frozenset(
    "san francisco los angeles new york london paris berlin munich münchen hamburg köln lyon marseille toulouse bordeaux madrid barcelona rome milan tokyo beijing shanghai delhi mumbai sydney boston chicago seattle"
    " texas california france germany deutschland spain italy england scotland ireland europe asia africa america united states kingdom north south east west central northern southern eastern western saint sainte"
    " mount lake river valley hill bay island park bridge station airport university college school hospital hotel church castle museum library city town village county republic".split()
)
#: Nouns and adjectives of work that stand capitalised in titles and in names of teams, products and days.
NOUNS = frozenset(
    "project team group department division committee council company bank fund agency institute service services system platform product release version sprint backlog roadmap milestone meeting review report summary"
    " analysis design architecture overview introduction conclusion chapter section appendix table figure guide manual policy process plan budget quarter contract invoice order account customer support sales marketing"
    " finance engineering operations security research development data machine learning science software hardware network cloud database server client cluster node pipeline queue cache index search engine model"
    " training test tests build deploy deployment error warning info debug user admin note notes todo action item items task list open source free general public private global local main master next last first second"
    " big small good best high low early late daily weekly monthly annual monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december"
    " lundi mardi mercredi jeudi vendredi samedi dimanche montag dienstag mittwoch donnerstag freitag samstag sonntag morning afternoon evening night day week month year the this that these those when after before if"
    " projekt équipe abteilung gruppe silver golden red blue black white grey".split()
)
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam mx mme mlle m me docteur professeur herr frau hr fr dipl ing".split())
CUES = {
    "phone": "call tel tél telephone téléphone phone mobile cell portable sms fax ring dial whatsapp hotline joignable joindre appeler appelez reach rappeler anrufen telefon handy rufnummer number numéro mobil landline".split(),
    "id": "ssn nir nino ni social security sécurité sociale insurance national identity id identité carte card passport passeport pass reisepass ausweis personalausweis steuer-id steuer tax tin idnr no number nummer licence license fiscal dni nie nif bsn cpf pesel steueridentifikationsnummer".split(),
    "name": "with by from to owner customer name named nom contact attention attn met ask call cc dear signed author reporter m mr mrs ms mme mlle dr prof herr frau appelle heiße heisse de for client kunde patient employee manager -- avec par von bei mit selon colleague kollege collègue sincerely regards best cordialement bonjour hallo hi hello thanks merci danke à an und et and".split(),
    "address": "at to address adresse anschrift wohnt wohnhaft lives live living resident residence located street home résidant demeurant habite domicile deliver delivery ship moved mail post sis à in near".split(),
    "email": "mail email e-mail courriel cc to bcc from écrire adresse address contact write reach at < mailto".split(),
    "machine": "checksum batch build version port commit pid code error sha md5 run ticket serial row rows id offset bytes line lines hash digest size count uptime epoch ts timestamp seq sequence block frame invoice order sku part ref listening since isbn tracking".split(),
    "repo": "git remote clone ssh url origin push pull fetch host jdbc scp rsync registry https http postgres mysql redis mongodb amqp repository repo".split(),
    "team": "team project projet projekt group squad service the le la les das die der department division company office équipe city near in between".split(),
}
CUES = {k: frozenset(v) for k, v in CUES.items()}
AFTER = {
    "verb": "asked lives wohnt moved said wrote called reported joined left wants prefers thinks agreed reviewed is was will has had can et and und habite peut a hat ist schreibt signed resigned confirmed emailed replied told explained works arrived who".split(),
    "thing": "project team department conference release version system service server university hotel station bridge street road museum committee report guide".split(),
    "ext": "ext ext. x extension poste durchwahl dw".split(),
    "machine": "rows items records ms seconds bytes tokens lines entries mb kb gb queries requests retries / % files users times".split(),
}
AFTER = {k: frozenset(v) for k, v in AFTER.items()}
ROLE = frozenset("git noreply no-reply root admin support info team ops hello contact sales billing security postmaster webmaster abuse deploy ci bot build jenkins svc service alerts help office hostmaster daemon mailer".split())
SURNAME_ENDS = tuple(
    "son sen ska ski sky ić enko chuk mann dorf etti elli ini ström strom berg stein eau eaux oux ière ault ez ova ov kova ikova ford ton ley man er stad sson gaard lund dal by ham esh oulet ovic owska owski wski mans kens sens ides poulos ian yan".split()
)
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžłćčńęąśźżđğşıēō", "aaaaaaceeeeiiiinoooooouuuuyyszlccneaszzdgsieo")

LEFT_WORD = re.compile(r"[^\s,;:|\"'(){}\[\]=]+|[<]|--")
RIGHT_WORD = re.compile(r"[^\s,;|\"'(){}\[\]=]+")
GROUPS = re.compile(r"\d+")


class Ranks:
    """How common words are, written small and capital, by their place in two public vocabularies; 17 stands for words that are none.

    Merges of a byte-pair vocabulary come in order of frequency, so this tells a noun that starts a title from a name.
    """

    NONE = 17.0

    def __init__(self, folder: str | None = None) -> None:
        self.known: list[dict[str, float]] = []
        for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
            with open(vocabulary_path(name, folder), "rb") as f:
                pairs = (line.split() for line in f)
                words = ((base64.b64decode(a), int(b)) for a, b in pairs)
                self.known.append({w[1:].decode("utf-8", "ignore"): math.log2(1 + r) for w, r in words if w[:1] == b" " and len(w) > 2})

    @lru_cache(maxsize=65_536)  # noqa: B019 - one object in a process
    def of(self, word: str) -> tuple[float, float, float, float]:
        low, cap = word.lower(), word.capitalize()
        return tuple(k.get(w, self.NONE) for k in self.known for w in (low, cap))


@lru_cache(maxsize=2)
def ranks(folder: str | None = None) -> Ranks:
    return Ranks(folder)


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int


def _names(text: str) -> Iterator[tuple[int, int]]:
    for m in NAMES.finditer(text):
        tokens = [(t.start(), t.end(), t[0]) for t in NAME_TOKEN.finditer(text, m.start(), m.end())]
        caps = [i for i, (_, _, t) in enumerate(tokens) if t[0].isalpha() and t[0].isupper() and len(t) > 1 and not (len(t) == 2 and t[1] == ".")]
        for x, i in enumerate(caps):
            for j in caps[x + 1 : x + 4]:
                inside = tokens[i + 1 : j]
                commas = sum(t == "," for _, _, t in inside)
                if commas > 1 or j - i > 5:
                    break
                yield tokens[i][0], tokens[j][1] - (2 if tokens[j][2][-2:] in ("'s", "’s") else 0)
                if j + 1 < len(tokens) and len(tokens[j + 1][2]) == 2 and tokens[j + 1][2][1] == "." and (commas or tokens[i][2].isupper()):
                    yield tokens[i][0], tokens[j + 1][1]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    german = any(p in low and r.search(low) for p, r in GERMAN_ENDS.items()) or GERMAN_PLACE.search(text)
    for pattern in (ADDRESS_EN, ADDRESS_FR, *[ADDRESS_DE] * bool(german)):
        for m in pattern.finditer(text):
            end = m.end() - (text[m.end() - 1] in ". ")
            if pattern is ADDRESS_EN and text[m.end() - 1] == ".":
                end = m.end() - 1
            yield m.start(), end
            unit = UNIT.match(text, end)
            if unit and unit.end() > end:
                yield m.start(), unit.end()
            if pattern is ADDRESS_DE:  # without the words before the street
                words = [m.start() + w.start() for w in re.finditer(rf"(?<=[ ])[{UP}]", m[0])]
                yield from ((w, end) for w in words if re.search(r"[^\W\d]{3,} ?\d", text[w:end]))


def candidates(text: str) -> list[Candidate]:
    """Spans that may be personal, with overlaps."""
    out = {Candidate(0, a, b) for a, b in _names(text)}
    if "@" in text:
        out |= {Candidate(1, *m.span()) for m in EMAIL.finditer(text)}
    if WRITTEN.search(text):
        out |= {Candidate(1, *m.span()) for m in EMAIL_WRITTEN.finditer(text)}
    for run in DIGITS.finditer(text):
        if sum(c.isdigit() for c in run[0]) < 7 or DATE.fullmatch(run[0]):
            continue
        for m in PHONE.finditer(text, run.start(), min(len(text), run.end() + 1)):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 16 and not DATE.match(m[0]) and not text[m.end() : m.end() + 1].isdigit():
                out.add(Candidate(2, *m.span()))
    if IDS.search(text):
        out |= {Candidate(3, *m.span()) for m in ID.finditer(text)}
    out |= {Candidate(4, a, b) for a, b in _addresses(text)}
    return sorted(out, key=lambda c: (c.start, c.end))


def features(text: str, c: Candidate) -> list[float]:
    """Format and context of a span as numbers; words count whole, never by a prefix of the text."""
    v = text[c.start : c.end]
    left, right = text[max(0, c.start - 60) : c.start].rpartition("\n")[2], text[c.end : c.end + 40].partition("\n")[0]
    before = [w.lower().strip(".?!") or w for w in LEFT_WORD.findall(left)[-7:]]
    after = [w.lower() for w in RIGHT_WORD.findall(right)[:3]]
    b, a = left[-1:], right[:1]
    last, first = before[-1] if before else "", after[0] if after else ""
    around = [
        kind_of(b), kind_of(a), kind_of(right[1:2]) if a in ".,:-" else -1,
        *(last in k for k in CUES.values()), *(any(w in k for w in before) for k in CUES.values()), *(first in k for k in AFTER.values()), *(any(w in k for w in after) for k in AFTER.values()),
        last in TITLES, not before, left.rstrip()[-1:] in ".!?" if left.strip() else 1,
    ]
    if c.kind == 0:
        return [*around, *_name_features(v, left, right, last, first)]
    groups = [len(g) for g in GROUPS.findall(v)][:6]
    local = re.split(r"@|\W(?:at|AT|arobase)\W", v)[0].lower().strip() if c.kind == 1 else ""
    return [
        *around, len(v), sum(x.isdigit() for x in v), sum(x.isalpha() for x in v), sum(x.isupper() for x in v), v[:1] == "+", v[:2] == "00", v[:1] == "0", "(" in v, "@" in v, "," in v,
        v.count("."), v.count("-"), v.count(" "), v.count("/"), len(groups), *(groups + [0] * 6)[:6], v[:1].isalpha(), v[-1:].isalpha(), v[:2].isalpha() and v[:2].isupper(),
        any(w in PLACES or w in NOUNS for w in v.lower().split()), bool(RIGHT_DIGIT.match(right)), bool(LEFT_DIGIT.search(left)), bool(RIGHT_POST.match(right)), bool(RIGHT_CAP.match(right)),
        bool(RIGHT_STREET.match(right)), bool(STREET_IN.search(v)), bool(STRASSE_IN.search(v)), bool((u := UNIT.match(right)) and u.end()), bool(LEFT_CAP.search(left)),
        local in ROLE or local.split(".")[0] in ROLE, "://" in left and " " not in left[left.rfind("://") :], a == ":" and right[1:2].isalpha(), v.count("["), bool(HEX_LEFT.search(left)), len(set(SEPARATORS.findall(v))),
        _street_rank(v) if c.kind == 4 else 0,
    ]


RIGHT_DIGIT, LEFT_DIGIT, RIGHT_POST = re.compile(r",? ?\d"), re.compile(r"\d,? $"), re.compile(r",? \d{4,5}\b")
RIGHT_CAP, LEFT_CAP = re.compile(rf"[ ,]+(?:{PARTICLE} )?[{UP}]"), re.compile(rf"[{UP}][\w’'-]*,? $")
RIGHT_STREET, STREET_IN, STRASSE_IN = re.compile(rf" (?i:{_STREET})\b"), re.compile(rf"(?i:\b(?:{_STREET}|{_RUE})\b)"), re.compile(rf"(?:{_STRASSE})")
HEX_LEFT, SEPARATORS = re.compile(r"[0-9a-f]{6,}$"), re.compile(r"[ .\-/]")
RIGHT_NAME, LEFT_PART, RIGHT_INITIAL, IS_PARTICLE = re.compile(rf",? [{UP}][{LOW}]"), re.compile(rf"(?:{PARTICLE}|[{UP}]\.) $"), re.compile(rf" [{UP}]\."), re.compile(PARTICLE)


def kind_of(ch: str) -> int:
    return 0 if not ch else 1 if ch == " " else 2 if ch in ".,;!?" else 3 if ch in "\"'<>`" else 4 if ch.isalnum() else 5 if ch in ":=" else 6 if ch in "@/\\" else 7


def _street_rank(v: str) -> float:
    """The rarest word's rank: streets are called by rarer words than counted things."""
    return max((min(ranks().of(w)) for w in re.findall(r"[^\W\d]{3,}", v)), default=0.0)


def _name_features(v: str, left: str, right: str, last: str, first: str) -> list[float]:
    tokens = [t for t in v.replace(",", " ").split(" ") if t]
    low = [t.lower().strip(".") for t in tokens]
    words = [t for t in tokens if len(t.strip(".")) > 1 and not IS_PARTICLE.fullmatch(t)]
    r = [ranks().of(w) for w in words]
    head, tail = r[0], r[-1]
    # a common word written small is hardly a name: how much commoner than its capital form
    lead = [min(x[0], x[2]) - min(x[1], x[3]) for x in r]
    surname = low[0] if "," in v or tokens[0].isupper() and len(tokens[0]) > 2 else low[-1]
    given = [any(p in FIRST for p in (w, *w.split("-"))) for w in low]
    family = [any(p in FAMILY for p in (w, *w.split("-"))) for w in low]
    return [
        len(v), len(tokens), len(words), sum(x.isupper() for x in v), "," in v, "." in v, v.count("-"), *head, *tail, max(lead), min(lead), lead[0], lead[-1], min(min(x[0], x[2]) for x in r), max(min(x) for x in r),
        min(min(ranks().of(last)[::2]), 17) if last.isalpha() else -1, min(min(ranks().of(first)[::2]), 17) if first.isalpha() else -1,
        given[0], given[-1], sum(given), family[0], family[-1], sum(family), sum(w in NOUNS for w in low), low[0] in NOUNS, low[-1] in NOUNS, sum(w in PLACES for w in low), low[-1] in PLACES, surname.endswith(SURNAME_ENDS),
        any(w in TITLES for w in low), any(IS_PARTICLE.fullmatch(t) for t in tokens), any(len(t) == 2 and t[1] == "." for t in tokens), sum(t.isupper() and len(t) > 2 for t in tokens), min(map(len, tokens)), max(map(len, tokens)),
        bool(LEFT_CAP.search(left)), bool(RIGHT_NAME.match(right)), bool(LEFT_PART.search(left)), bool(RIGHT_INITIAL.match(right)), bool(RIGHT_DIGIT.match(right)), bool(LEFT_DIGIT.search(left)), v[-3:].lower() in ("ing", "ion", "ent", "ure", "ung", "ity"),
    ]


# --- texts for training -------------------------------------------------------------------------------

#: Frames of the training texts; a slot in braces is filled anew each time. All are written for this module from common forms of letters, mails, records and logs.
FRAMES = {
    "name_left": [
        "I talked to ", "We had lunch with ", "Kind regards, ", "Best, ", "Cordialement, ", "Mit freundlichen Grüßen ", "author: ", "Author: ", "assignee = ", "Reviewer: ", "From: ", "To: ", "Dear ", "Dear Mr ", "Sehr geehrte Frau ", "Sehr geehrter Herr ", "Bonjour ", "Merci à ",
        "Danke an ", "Copyright (c) 2019 ", "@author ", "prepared for ", "payee: ", "Kontoinhaber: ", "Nom : ", "Name: ", "Full name: ", "the lawyer of ", "our neighbour ", "the novelist ", "the nurse, ", "a letter from ", "the minutes were taken by ", "as ", "because ", "Yesterday ", "Hi ", "cc ", "CC: ",
        "invited: ", "le docteur ", "Mme ", "M. ", "Dr. ", "Prof. ", "mon collègue ", "unser Kollege ", "laut ", "selon ", "von ", "par ", "by ", "with ", "ask ", "ping ", "thanks to ", "born as ", "signed: ", "Signed by ", "/s/ ", "contact: ", "manager=", "", "", "", "- ", "* ", "(", "and ", "et ", "und ", "of ", "for ",
        "On Friday ", "Then ", "Later ", "reports to ", "hired ", "met ", "interview of ", "{verb} ", "{verb} by ", "The {word} {verb} ", "{word}: ", "without ", "since ", "{word} of ", "{word} to ", "is ", "est ", "ist ", "présenté par ", "vertreten durch ", "der Mieter ", "le locataire ", "the tenant ", "emergency contact ", "account holder ", "on behalf of ", "beneficiary ",
    ],
    "name_right": [
        " will join us tomorrow.", " has resigned.", ", who leads the branch,", " (born {year})", "'s laptop broke", " called back twice.", " a signé le contrat.", " hat unterschrieben.", ".", "", "", ";", " and the lawyer disagreed", " confirmed the date.", " emailed me about it", " wrote:", " said no.", " est absent.",
        " ist krank.", ", {date}", " - {date}", ")", "?", "!", ": please check", " told us that {word} is late", " from {city}", ", {city}", " wants a copy", " and {name}", ", {name} and {name}", " et {name}", " und {name}", " & {name}", " is on leave until {date}", " explained the {word}", " {verb} the {word}", " {verb} and {verb} it", " was {verb} by {word}", " who {verb}", " {verb} {num} times", " isn't {verb}", " was {verb}", " thinks so too", " paid {num} euros", " works here since {year}",
        "\nDirector", ", Director", ", PhD", " |", " / {num}", " [{word}]", " @{word}", " about {word}", " regarding the {word}", " for {word}", " on {date}.", " at {num}:30", " about {word}-{word} and {code}.", " before {date}", " vor {date}", " avant {date}", " because of {code}", " did not test {word}.", " pour {word}", " wegen {word}",
    ],
    "email_left": ["write to ", "{UPPER} ", "{word} ", "{verb} ", "{word}: ", "the {word} of ", "Mail: ", "e-mail : ", "send it to ", "my address is ", "mailto:", "From: <", "user=", "login: ", "reply-to ", "", "contact ", "schreiben an ", "écrivez à ", "erreichbar unter ", "joignable à ", "cc: ", "bcc ", "email=", "\"email\": \"", "(", "invite ", "subscribed: ", "git config --global user.email ", "bounced: "],
    "email_right": ["", ".", ">", "\"", ", thanks", " for details", " asap", ")", " pour plus d'infos", " bitte", ";", " and wait", " id={num}", " bounced", " when {word} fails", " - {date}", " ip=10.0.{num}.7", " si {word} échoue", " about {code}"],
    "phone_left": ["call ", "Call me on ", "Tel: ", "Tél : ", "Phone ", "mobile: ", "my number is ", "ring ", "Telefon ", "Handy: ", "unter ", "au ", "dial ", "fax ", "WhatsApp ", "text ", "phone=", "\"phone\":\"", "reach us at ", "(", "joignable au ", "Rufnummer ", "or ", "cell ", ", ", "{word} line, ", "{word}: ", "{role} ", "sms to ", "emergency: ", "rappeler le ", "tel. ", "☎ "],
    "phone_right": ["", ".", ", {verb}", ", is {word}", " is {verb}", ", which {verb}", " before noon", " ext. 12", " ext 4", " x201", " after {date}", ")", "\"", ",", ";", " (mobile)", " please", " s'il vous plaît", " Durchwahl 7", " poste 12", " if {word} stops", " from {word}", " by {word}", " (ask for {word})", " |"],
    "id_left": ["{label} ", "{label}: ", "{label} : ", "{label}=", "{label} is ", "with {label} ", "his {label} ", "{label} no. ", "sa {label} ", "meine {label} lautet ", "({label} ", "{label} #", "\"{label}\": \"", "{label} number ", "holder of {label} ", "{label} as typed into the form of {word}: ", "{label}, given by the person at {word}, is ", "{label} de la personne chez {word} : ", "{label} der Person bei {word}: ", "{label} (copy attached): "],
    "id_right": ["", ".", ",", " valid until {date}", ")", "\"", " verified", " issued in {city}", ";", " gültig bis {year}", " was checked on {date}", " on file", " for {word}", " and {word}"],
    "address_left": ["I live at ", "our office is at ", "Address: ", "Adresse : ", "Anschrift: ", "deliver to ", "wohnhaft ", "wohnt in der ", "demeurant ", "au ", "visit us: ", "home address ", "the flat at ", "street=", "\"street\": \"", "le bureau se trouve ", "parcel for ", "pick it up at ", "send the keys to ", "", "moved from ", "moved to ", "habite ", "wohnt ", "meets at ", "the house, ", "registered at ", "billed to ", "residing at ", "Lieferung an "],
    "address_right": ["", ".", ", {city}", ", {post} {city}", ", {city} {post}", " in {city}", "\"", ";", " ({city})", ", second door", ", à {city}", " and ring twice", ", see {code}", ", attn. {name}", " ; {word}", ", {city}; call {phone}"],
    "record": [
        "{num};{name};{email};{phone}", "{name},{date},{idnum},{addr}", "{idnum};{name};{city}", "{num}|{idnum}|{name}|{phone}", "{name};{addr};{idnum};{num}", "{name}\t{phone}\t{city}", "INSERT INTO people VALUES ({num}, '{name}', '{addr}', '{phone}');", "{{\"id\": {num}, \"full_name\": \"{name}\", \"mail\": \"{email}\"}}", "{{\"holder\": \"{name}\", \"{label}\": \"{idnum}\"}}", "BEGIN:VCARD FN:{name} TEL:{phone} EMAIL:{email}",
        "<td>{name}</td><td>{addr}</td>", "{name} <{email}>", "From: {name} <{email}>", "Co-authored-by: {name} <{email}>", "{name} ({email}) - {phone}", "| {name} | {phone} | {word} |", "{name}, {addr}, {post} {city}", "Tenant {name}, {label} {idnum}, pays on the 5th", "name={name} phone={phone} plan={word}", "{name} / {label} {idnum} / {date}",
        "dn: cn={name},ou={word},mail={email}", "Patient {name}, {label} {idnum}, seen on {date}", "{name} lives at {addr}, {city}", "{name} wohnt {addr}", "{name} habite au {addr}, {city}", "Locataire : {name}, {addr}. Tél. {phone}", "{name} moved to {addr}", "My name is {name} and my phone is {phone}", "je suis {name}, mon mail : {email}", "ich bin {name}, Telefon {phone}",
        "{role}: {name}, phone {phone}, mail {email}", "to {name} at {addr}", "{name} signed for {label} {idnum}", "{num} {date} INFO {word} user={email} ok", "{name}: I will call {phone} tonight", "{word} | {name} | {label}: {idnum} | {addr}", "lease: {addr}, {city}, {name}, {idnum}", "{name} wants the invoice, {label} {idnum}.", "{role} {name} reachable at {email} or {phone}",
    ],
    "none": [
        "{Thing} meets on {date} in {place}", "The {thing2} was moved to {place}", "Welcome to {place}", "{Thing} and {thing2} depend on {word}", "both {Thing} and {thing2} use {word}", "{thing2} and {Thing}: same {word}", "{thing2}, {Thing} and {thing1} get a new {word}", "by {thing2} only", "with {thing2} we", "{Thing} is slow", "{Thing} {verb} the {word}", "{proper} {thing1} {verb} {num} times", "the {proper} {thing1}", "{Thing} was {verb} by {word}", "{verb} by {Thing}", "{word} of {thing2}", "{word} of {place}", "{thing1} of {thing1}: {word}", "{verb} {Thing} and {place}", "{Thing} der {thing1}: {word}", "{thing1} des {thing2}s: {num}", "{UPPER} {word}", "{UPPER} {UPPER} {UPPER}({UPPER}_{UPPER}: {UPPER})", "{UPPER}\n{UPPER} {UPPER}.{UPPER}({num})", "{UPPER} {UPPER} = {num};", "/* {UPPER} {UPPER} {UPPER} */", "is {thing2}", "{place} {verb} again", "{Thing} has {num} {word}", "# {Title}", "## {Title}", "{Title}: see section {num}", "{Title}", "* {Title} - {num} pages", "We flew to {place} on Monday", "{place} is {num} km away", "the {org} report of {year}", "{org} bought {org}", "{org} hired {num} people", "a talk on {Title}",
        "import {Camel}; new {Camel}().run()", "class {Camel}({Camel}):", "SELECT {UPPER} FROM {UPPER} WHERE ID = {num}", "WARN {UPPER} {UPPER} {num}", "{Thing} {num} starts at {num}:00", "Team {thing2} won", "Project {thing2}, phase {num}", "Die {thing2} ist fertig", "Le {thing2} est prêt", "{weekday} {daytime} is fine for {Thing}", "{Thing} {num} serves {word} for {thing2}",
        "total {big} of {big2} bytes", "{num} of {big} rows, batch {long}", "order {dashed} shipped", "invoice {dashed} of {date}", "isbn 978-{num}-{big}-{num}", "tracking {long}", "ip 192.168.{num}.{num} port {num}", "at {date} {num}:{num}:{num}", "sha {hex}", "commit {hex} by {word}", "version {num}.{num}.{num}", "epoch {long}", "lat {num}.{big} lon {num}.{big}", "id {hex}-{num}", "run {num} {num} {num}", "error {num}-{num} in {word}",
        "serial {ser}", "asset {ser} in room {num}", "uptime {big} seconds", "{big} / {big2} checks passed", "part {dashed}-B", "{year}-{num}-{num} {num} {word}", "price {num}.{num}.{num}", "ssh {word}@{word}.example.org", "scp a.txt {word}@{word}.example.net:/tmp", "git@{word}.example.com:{word}/{word}.git", "git clone ssh://git@{word}.example.com/{word}.git", "https://{word}:{word}@{word}.example.org/{word}",
        "postgres://{word}:{word}{num}@{word}.example.com:5432/{word}", "npm i @{word}/{word}", "npm install {word}@{num}.{num}.{num}", "require('@{word}/{word}@{num}.{num}.{num}')", "\"@{word}/{word}@{num}.{num}.{num}\",", "redis://:{secret}@{word}.example.net:6379", "mongodb://{word}:{secret}@{word}.{word}.example.org/{word}", "curl https://{word}:{secret}@{word}.example.net", "amqp://{word}:{secret}@{word}{num}.example.com/{word}", "{role_mail}@{word}.example.com is the list", "@{word}.get('/{word}/{num}')", "{num} Main {thing1} left", "{num} {Thing} and {num} {thing2}", "the {num} Old {thing1} rules", "route {num} to {place}", "{num} {Title}", "place {num} in the ranking", "Kapitel {num} {thing2}", "see {Thing} {num}", "{thing1} {num} of {num}", "{num} {Thing} {num} {thing2}",
        "build {num} took {big} ms on {word}", "pid {num} listens on {num}", "retry {num} after {big} ms, ref {long}", "checksum {long} vs {long}", "{Thing} writes {num} {num} to {word}", "user {word} has {num} tokens", "blk_{long}", "mem {big} {big2} {big}", "{num} {Adj} {street} improvements", "{Title} by {thing2}", "{place} {num}", "{org}, {place}", "the {place} office of {org}", "Dear {thing1} team", "From {place} with love", "cc the {thing2}",
    ],
}
BRANDS = "Apache Kafka,Apache Spark,Machine Learning,Deep Learning,Visual Studio,Red Hat,Open Source,Google Cloud,Amazon Web Services,Data Science,Stack Overflow,Black Friday,World Bank,Supreme Court,Pull Request,Unit Tests,Null Pointer,Happy Path,Single Sign".split(",")
ID_FORMS = {
    "SSN": ("ddd-dd-dddd", "ddd dd dddd"), "social security number": ("ddd-dd-dddd",), "NIR": ("1 dd 0D dd ddd ddd dd", "2dd0Dddddddddd", "1 dd 1d 2A ddd ddd dd"), "numéro de sécurité sociale": ("2 dd 0D dd ddd ddd", "1dd1dddddddddd"), "Steuer-ID": ("dd ddd ddd ddd", "ddddddddddd"), "tax id": ("ddddddddddd", "ddd-dd-dddd"),
    "NI number": ("LLddddddA", "LL dd dd dd C"), "national insurance": ("LLddddddB",), "passport": ("Ldddddddd", "LLddddddd", "ddddddddd"), "passeport": ("ddLLddddd",), "Reisepass": ("Ldddddddd",), "identity card": ("dd-dddd-dddd-L", "dddddddddddd"), "carte d'identité": ("dddddddddddd",), "Personalausweis": ("Ldddddddd",), "DNI": ("ddddddddL", "dddddddd-L"), "NIE": ("Xddddddd-L",), "tax number": ("ddd-ddd-ddd",),
    "national id": ("dddddd-dddd", "ddddddddddd"), "codice fiscale": ("LLLLLLddLddLdddL",),
}
PHONE_FORMS = (
    "+33 d dd dd dd dd", "0033 d dd dd dd dd", "0D dd dd dd dd", "0D.dd.dd.dd.dd", "+33ddddddddd", "+33.D.dd.dd.dd.dd", "+44 dd dddd dddd", "+44 7ddd dddddd", "07ddd dddddd", "0dd dddd dddd", "+49 dd ddddd ddd", "+49 ddd ddddddd", "0ddd ddddddd", "0ddd/dddddd", "0dd ddddddd", "(Ddd) ddd-dddd", "+1 (Ddd) ddd-dddd", "+1Dddddddddd", "Ddd-ddd-dddd",
    "Ddd.ddd.dddd", "+1 Ddd ddd dddd", "+1-Ddd-ddd-dddd", "Ddd ddd dddd", "+34 ddd ddd ddd", "+39 0d dddd dddd", "+41 dd ddd dd dd", "+32 d ddd dd dd", "+48 ddd ddd ddd", "+91 ddddd ddddd", "+81 d-dddd-dddd", "+31 d dddd dddd", "+351 ddd ddd ddd", "+43 d ddddddd", "+46 dd ddd dd dd", "01dd ddddddd",
)


class _Writer:
    """Texts with known spans, of frames with slots. Half of the names come of syllables, so no list has to be remembered."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.first, self.family = sorted(FIRST), sorted(FAMILY)
        self.nouns, self.places = sorted(NOUNS), sorted(PLACES)
        self.common = sorted(w for w in ranks().known[0] if len(w) > 3 and w.isascii() and w.isalpha() and w.islower())
        self.verbs = [w for w in self.common if w.endswith("ed")]
        # words of the vocabulary that are hardly ever written small: names of people, and as many of places and firms
        self.proper = sorted(w for k in ranks().known for w in k if len(w) > 3 and w.isalpha() and w[0].isupper() and w[1:].islower() and all(w.lower() not in j for j in ranks().known) and w.lower() not in NOUNS)

    def pick(self, *x: str) -> str:
        return self.r.choice(x)

    def syllables(self, n: int) -> str:
        c, v = "b br c ch d dr f g gr h j k kh l m n ng p pr r s sh st t th v w y z".split(), "a a e e i i o o u ai ei ou ie ya é ö".split()
        return "".join(self.r.choice(c) + self.r.choice(v) for _ in range(n))

    def word(self) -> str:
        """A small word: a common one, or two put together, or none of any language."""
        x = self.r.random()
        if x < 0.4:
            return self.r.choice(self.common)
        return self.r.choice(self.common) + self.pick("", "-", "_") + self.r.choice(self.common) if x < 0.7 else self.syllables(3).translate(ACCENTS)

    def first_name(self) -> str:
        x = self.r.random()
        if x < 0.45:
            return "-".join(p.capitalize() for p in self.r.choice(self.first).split("-"))
        if x < 0.65:
            return self.r.choice(self.proper)
        return self.syllables(self.r.choice([1, 2, 2, 3])).capitalize() + self.pick("", "", "n", "l", "s", "ne", "ta", "rd", "r", "m")

    def surname(self) -> str:
        x = self.r.random()
        if x < 0.25:
            return self.r.choice(self.family).capitalize()
        if x < 0.35:
            return self.r.choice(self.proper)
        if x < 0.65:
            return self.syllables(self.r.choice([1, 1, 2])).capitalize() + self.pick("", "n", "l", "r") + self.r.choice(SURNAME_ENDS)
        if x < 0.7:
            return self.pick("Mc", "Mac", "O'", "D'", "Le", "Di", "O’") + self.syllables(2).capitalize() + self.pick("n", "y", "l", "")
        if x < 0.78:  # many surnames are common words
            return self.pick("Bishop", "Stone", "Rivers", "Fields", "Winter", "Long", "Rose", "Fox", "Wood", "Marsh", "Banks", "Price", "Cook", "Berger", "Petit", "Lang", "Vogel", "Sommer", "Roth", "Page", "Day", "Love", "Church", "West", "Lane")
        return self.syllables(self.r.choice([2, 2, 3])).capitalize() + self.pick("", "n", "s", "rs", "k", "t", "lt", "x", "nd")

    def name(self) -> str:
        first, last = self.first_name(), self.surname()
        x = self.r.random()
        if x < 0.1:
            last += "-" + self.surname()
        elif x < 0.22:
            last = self.pick("de", "von", "van", "del", "di", "van der", "de la", "al", "da", "zu", "bin", "ten", "le") + " " + last
        if self.r.random() < 0.08:
            first += "-" + self.first_name().split("-")[0]
        middle = f" {self.pick(*'ABCDEFGHJKLMNPRST')}." if self.r.random() < 0.15 else ""
        x = self.r.random()
        if x < 0.68 or (x >= 0.85 and " " in last):
            return f"{first}{middle} {last}"
        return f"{last}, {first}{middle}" if x < 0.84 else f"{last.upper()} {first}{middle}" if x < 0.95 else f"{first} {last.upper()}"

    def email(self) -> str:
        a, b = (re.sub(r"[^a-z]", "", x.lower().translate(ACCENTS)) for x in (self.first_name(), self.surname()))
        local = self.pick(f"{a}.{b}", f"{a}_{b}", f"{a[:1]}{b}", f"{a}{self.r.randint(1, 99)}", f"{b}-{a}", f"{a}+{self.syllables(2).translate(ACCENTS)}", b, f"{b}_{a}", f"{b}.{a[:1]}", f"{a}.{b}{self.r.randint(60, 99)}")
        host = self.pick("", "", "mail.", "post.", "intra.") + re.sub(r"[^a-z]", "", self.word()) + self.pick(".com", ".org", ".example", ".example.com", ".net", ".fr", ".de", ".co.uk", ".io", ".example.org", ".test", ".invalid")
        x = self.r.random()
        at, dot = self.pick((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), (" arobase ", " point "), (" at ", "."), (" <at> ", " <dot> "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" @ ", "."))
        if x < 0.2:
            return (local.replace(".", dot) if self.r.random() < 0.5 else local) + at + host.replace(".", dot)
        return f"{local}@{host}".upper() if x < 0.24 else f"{local}@{host}"

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if ch == "d" else str(self.r.randint(1, 9)) if ch == "D" else self.r.choice("ABCDEFGHJKLMNPRSTXYZ") if ch == "L" else ch for ch in form)

    def address(self) -> str:
        n, x = self.r.randint(1, 2400), self.r.random()
        w = self.r.choice([self.surname, lambda: self.syllables(2).capitalize() + self.pick("", "ton", "field", "wood", "bury"), lambda: self.r.choice(self.nouns).capitalize(), lambda: self.pick("Oak", "Maple", "Church", "Station", "Mill", "Victoria", "Park", "Jardin", "Moulin", "Gare", "Linden", "Bahnhof", "Kirch", "Schiller", "Rosen")])().replace("’", "'")
        kind = self.pick("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Close", "Terrace", "Blvd", "Boulevard", "Way", "Court", "Square", "Crescent", "Place", "Grove", "Hill")
        if x < 0.42:
            street = f"{n} {self.pick('', '', '', 'North ', 'Old ', 'Upper ', 'West ', 'Great ', 'E. ')}{w} {kind}"
            return street + (self.pick(", Apt ", ", Unit ", ", Suite ", ", Flat ", " Apt ", " #", ", Apartment ", " Suite ") + str(self.r.randint(1, 90)) + self.pick("", "", "B", "A") if self.r.random() < 0.25 else "")
        if x < 0.74:
            way = self.pick("rue", "rue", "avenue", "boulevard", "place", "impasse", "chemin", "allée", "quai", "cours", "route")
            link = self.pick("de la ", "des ", "du ", "de ", "", "de l'" if w[0] in "AEIOUÉ" else "")
            return f"{self.r.randint(1, 200)}{self.pick('', '', '', ' bis', ' ter', 'B')}{self.pick(' ', ' ', ', ')}{way} {link}{w}{self.pick('', '', '', '-' + self.first_name())}"
        street = w.split("-")[0].split("'")[-1] + self.pick("straße", "str.", "weg", "gasse", "platz", "allee", "strasse", "ring", "ufer", "damm") if self.r.random() < 0.8 else self.pick("Am ", "An der ", "Im ", "Zum ", "Alte ") + w.split("-")[0].split("'")[-1] + self.pick("", "straße", "platz")
        return f"{street} {self.r.randint(1, 199)}{self.pick('', '', 'a', 'b', ' c')}"

    def title(self, n: int) -> str:
        word = lambda: self.r.choice(self.nouns) if self.r.random() < 0.4 else self.r.choice(self.common) if self.r.random() < 0.85 else self.syllables(2)
        return " ".join(word().capitalize() for _ in range(n))

    def slot(self, name: str) -> str:
        r, c = self.r, self.r.choice
        match name:
            case "thing1":
                return self.title(1)
            case "thing2" | "Thing":
                return self.title(c([2, 2, 2, 3])) if r.random() < 0.8 else c(BRANDS) if r.random() < 0.5 else self.syllables(2).capitalize() + " " + self.title(1)
            case "Title":
                return self.title(c([2, 3, 4])) if r.random() < 0.8 else c(BRANDS)
            case "place":
                return self.pick("San Francisco", "New Delhi", "Saint Martin", "Mount Vernon", "Los Altos", "Bad Homburg", "Le Mans", "Cape Town", "Buenos Aires", "Costa Rica") if r.random() < 0.3 else " ".join(w.capitalize() for w in (c([c(self.places), c(self.proper), self.syllables(2)]), c([c(self.places), c(self.places), c(self.nouns)])))
            case "org":
                return self.pick(self.surname(), self.r.choice(self.proper)) + self.pick(" Bank", " Institute", " Group", " GmbH", " Holdings", " University", " & Sons", " Labs", " Foundation", " Systems")
            case "city":
                return self.syllables(2).capitalize() + self.pick("", "ville", "stadt", "burg", "ton", "port")
            case "Camel":
                return self.title(2).replace(" ", "")
            case "UPPER":
                return c(self.nouns).upper()
            case "Adj":
                return self.pick("Great", "Small", "New", "Major", "Urgent", "Open")
            case "street":
                return self.pick("Way", "Place", "Court", "Square", "Row")
            case "weekday":
                return self.pick("Monday", "Tuesday", "Friday", "Sunday", "Mardi", "Montag")
            case "daytime":
                return self.pick("Morning", "Evening", "Night", "Lunch")
            case "num":
                return str(r.randint(1, c([9, 99, 999])))
            case "big":
                return str(r.randint(1000, 999999))
            case "big2":
                return str(r.randint(10**6, 10**8))
            case "long":
                return self.digits("D" + "d" * r.randint(6, 14))
            case "dashed":
                return self.digits(self.pick("ddd-ddd-dddd", "dd-dddd-dddd", "ddd-ddd-ddd", "dddd-dddd", "dddddd-dddd", "ddd-dd-dddd"))
            case "verb":
                return c(self.verbs)
            case "proper":
                return c(self.proper)
            case "secret":
                return "".join(c("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789-_.") for _ in range(r.randint(8, 32)))
            case "hex":
                return f"{r.getrandbits(c([32, 160])):08x}"
            case "ser":
                return self.digits(self.pick("LLddddddd", "Ldddddddd", "ddLLddddd", "LLddddddL"))
            case "code":
                return self.digits(self.pick("LLL-dddd", "LL-ddd", "#dddd", "LLLL-ddd"))
            case "date":
                return self.digits(self.pick("202D-0D-1d", "0D.1d.202D", "1d/0D/202D", "1d May 202D", "March 1d"))
            case "year":
                return self.digits("19dd")
            case "post":
                return self.digits("Ddddd")
            case "role":
                return self.pick("Owner", "Manager", "Tenant", "Nurse", "Driver", "Gérant", "Mieter", "Customer", "Guest")
            case "role_mail":
                return c(sorted(ROLE))
            case _:
                return self.word()

    def fill(self, frame: str) -> tuple[str, set[tuple[int, int, int]]]:
        """The frame with its slots filled, and the spans (type, start, end)."""
        out, spans, size, label = [], set(), 0, self.r.choice(sorted(ID_FORMS))
        make = {"name": (0, self.name), "email": (1, self.email), "phone": (2, lambda: self.digits(self.r.choice(PHONE_FORMS))), "idnum": (3, lambda: self.digits(self.r.choice(ID_FORMS[label]))), "addr": (4, self.address)}
        for i, part in enumerate(re.split(r"(?<!\{)\{(\w+)\}", frame)):
            if i % 2 == 0:
                text = part.replace("{{", "{").replace("}}", "}")
            elif part in make:
                text = make[part][1]()
                spans.add((make[part][0], size, size + len(text)))
            else:
                text = (label.upper() if self.r.random() < 0.1 else label) if part == "label" else self.slot(part)
            out.append(text)
            size += len(text)
        return "".join(out), spans

    def text(self) -> tuple[str, set[tuple[int, int, int]]]:
        """One to three pieces and their spans."""
        whole, spans = self.pick("", "", "", "- ", "> ", "USER: ", "// ", "* ", "# "), set()
        for i in range(self.r.choice([1, 1, 2, 3])):
            x = self.r.random()
            kind = self.r.choice(["name", "name", "email", "phone", "id", "address"])
            frame = self.r.choice(FRAMES["none"]) if x < 0.36 else self.r.choice(FRAMES["record"]) if x < 0.6 else self.r.choice(FRAMES[kind + "_left"]) + {"id": "{idnum}", "address": "{addr}"}.get(kind, f"{{{kind}}}") + self.r.choice(FRAMES[kind + "_right"])
            text, found = self.fill(frame)
            whole += (self.pick(". ", "\n", "; ", "\n", " - ") if i else "")
            spans |= {(k, a + len(whole), b + len(whole)) for k, a, b in found}
            whole += text
        return whole, spans


def training_rows(texts: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, whether true) of the candidates of written texts, by type."""
    writer = _Writer(seed)
    x: list[list] = [[] for _ in TYPES]
    y: list[list] = [[] for _ in TYPES]
    for _ in range(texts):
        text, truth = writer.text()
        for c in candidates(text):
            x[c.kind].append(features(text, c))
            y[c.kind].append(tuple(c) in truth)
    return [(np.array(a, np.float64), np.array(b, np.float64)) for a, b in zip(x, y, strict=True)]


class Model(NamedTuple):
    trees: tuple[Trees, ...]
    thresholds: tuple[float, ...]


def fitted(texts: int = TEXTS, seed: int = 7) -> Model:
    """The trees of every type; the same for every call, and of a size bounded by texts."""
    trees, thresholds = [], []
    for x, y in training_rows(texts, seed):
        held = np.random.default_rng(seed).random(len(x)) < HELD_OUT
        model = calibrated(fit(x[~held], y[~held], trees=100), x[held], y[held])
        trees.append(model)
        thresholds.append(best_threshold(model.probability(x[held]), y[held]))
    return Model(tuple(trees), tuple(thresholds))


def digest() -> str:
    """What a stored model was made of: this module, the boosting, and the number of texts."""
    here = Path(__file__).parent
    return hashlib.sha256(b"".join((here / n).read_bytes() for n in ("pii.py", "boosting.py")) + str(TEXTS).encode()).hexdigest()[:16]


@lru_cache(maxsize=2)
def trained(texts: int = TEXTS) -> Model:
    """The model as fitted() gives it; read from MODEL where that was made of just this code (python -m skein.llm.pii writes it)."""
    if texts == TEXTS and MODEL.exists():
        kept = json.loads(MODEL.read_text())
        if kept["digest"] == digest():
            return Model(tuple(Trees(*(np.array(t[k]) for k in ("feature", "at", "leaf")), *t["rest"]) for t in kept["trees"]), tuple(kept["thresholds"]))
    return fitted(texts)


def write_model() -> None:
    model = fitted()
    trees = [{"feature": t.feature.tolist(), "at": np.round(np.where(np.isinf(t.at), 1e9, t.at), 6).tolist(), "leaf": np.round(t.leaf, 5).tolist(), "rest": [t.start, t.slope, t.shift]} for t in model.trees]
    MODEL.write_text(json.dumps({"digest": digest(), "thresholds": model.thresholds, "trees": trees}, separators=(",", ":")))


def find(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int, float]]]:
    """Of each text the chosen (type, start, end, probability), in order and without overlap."""
    rows, where = [], []
    for i, t in enumerate(texts):
        if t:
            for c in candidates(t):
                rows.append(features(t, c))
                where.append((i, c))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    kinds, p = np.array([c.kind for _, c in where], np.int64), np.zeros(len(where))
    for k in range(len(TYPES)):
        at = np.flatnonzero(kinds == k)
        if len(at):
            q = model.trees[k].probability(np.array([rows[i] for i in at], np.float64))
            p[at] = np.where(q >= model.thresholds[k], q, 0)
    by_text: dict[int, list[tuple[float, Candidate]]] = {}
    for (i, c), q in zip(where, p, strict=True):
        if q > 0:
            by_text.setdefault(i, []).append((q, c))
    for i, found in by_text.items():
        taken: list[tuple[int, int, int, float]] = []
        for q, c in sorted(found, key=lambda f: (-f[0], f[1].start - f[1].end, f[1].start)):
            if all(c.end <= a or b <= c.start for _, a, b, _ in taken):
                taken.append((c.kind, c.start, c.end, float(q)))
        out[i] = sorted(taken, key=lambda f: f[1])
    return out


def details_in(df: DataFrame, key: str = "id", text: str = "content", *, texts: int = TEXTS) -> DataFrame:
    """(key, pii_type, start, end, pii_text, probability) of every personal detail.

    Null, empty and clean texts give no row; repeated rows give repeated rows; other columns are not read.
    """
    model = df.sparkSession.sparkContext.broadcast(trained(texts))  # a few hundred kB, whatever the data
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1).to_pylist()
            rows = [(i, TYPES[k], a, b, contents[i][a:b], p) for i, found in enumerate(find(contents, model.value)) for k, a, b, p in found]
            at, *rest = zip(*rows, strict=True) if rows else ((),) * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(rest, types, strict=True))], ["key", "pii_type", "start", "end", "pii_text", "probability"])

    out = spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind}, pii_type string, start int, end int, pii_text string, probability double")
    return out.withColumnRenamed("key", key)


def redact_details(df: DataFrame, key: str = "id", text: str = "content", *, texts: int = TEXTS) -> DataFrame:
    """(key, text, n_details) of every row, each detail replaced by its type in brackets; null texts stay null."""
    model = df.sparkSession.sparkContext.broadcast(trained(texts))
    kind = df.schema[key].dataType.simpleString()

    def replaced(t: str | None, found: list[tuple[int, int, int, float]]) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for k, a, b, _ in found:
            out += [t[at:a], f"[{TYPES[k].upper()}]"]
            at = b
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1).to_pylist()
            found = find(contents, model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([replaced(t, f) for t, f in zip(contents, found, strict=True)], pa.string()), pa.array([len(f) for f in found], pa.int32())], ["key", "text", "n_details"])

    out = spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind}, text string, n_details int")
    return out.toDF(key, text, "n_details")


if __name__ == "__main__":
    write_model()
