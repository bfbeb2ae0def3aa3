"""Pattern detector: one pass of all rules over a text, with each rule's own check of what it met.

A rule's pattern may capture the value itself as group 1, after the words that
announce it.  ``needs`` holds literals of which every match has one, and
``words`` sets of words of each of which it has one, so that a text without any
skips the rule; "0" stands for a digit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plain import DIGIT_WORDS, TIMES_WORDS, luhn_ok, normalize, spoken_cardinal, spoken_digits
from ..plans.storage import spread
from .claims import DETECTION, Claim


def either(words: str) -> str:
    """An alternative of words, in their order; an underscore is any white space."""
    return "(?:" + "|".join(w.replace("_", r"\s+") for w in words.split()) + ")"


#: Parts of the patterns.
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in "january february march april june july august october november december".split()) + "|may|sep(?:t|tember)?)"
STREETS = "street st road rd avenue ave lane ln drive dr close court ct crescent way place pl terrace grove gardens? park hill row square sq boulevard blvd parade walk mews rise view circle cir highway hwy route apartment apt flat unit"
STREET = either(STREETS)
UNIT = r"(?:flat|apt|apartment|unit|suite|no\.?|number|house)"
DIGIT = either(r"zero oh nought naught one two three four five six seven eight nine double triple treble \d")
ONES = either("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen")
TENS = either("twenty thirty forty fourty fifty sixty seventy eighty ninety")
NUMBER = rf"(?:{TENS}(?:[\s-]{ONES})?|{ONES})"
ORDINAL = r"(?:(?:twenty|thirty)[\s-])?" + either("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth")
YEAR_SAID = rf"(?:nineteen|twenty)(?:[\s-](?:hundred|and|oh|zero|{TENS}|{ONES})){{1,3}}"
DATE_SAID = rf"(?:the\s+)?{ORDINAL}\s+of\s+{MONTH}(?:\s+(?:{YEAR_SAID}|\d{{4}}))?"
DAY = r"(?:0?[1-9]|[12]\d|3[01])"
NTH = "(?:st|nd|rd|th)?"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
CAP = r"(?-i:[A-Z][\w'&-]*)"
CODE = r"(?-i:[A-Z0-9][A-Z0-9-]{2,19})"
AMPM = r"(?:am|pm|a\.m\.|p\.m\.)"
IS = r"\s*(?:is|:|=)?"
NUMBERED = r"(?:id|number|no\.?|#)"
SIGN = either("dot underscore dash hyphen")
PART = r"[A-Za-z0-9'-]"
#: Head nouns of schools, teams, clubs and landmarks.
SCHOOLS = r"School|Academy|College|Primary|Secondary|Nursery|Preschool|Pre-school|Kindergarten|Daycare|Day\s?Care|Montessori|Grammar|Elementary|Institute"
SCHOOLS_LOW = "school academy primary secondary nursery college preschool pre-school kindergarten montessori daycare"
TEAMS = r"FC|F\.C\.|United|Rovers|Tigers|Lions|Eagles|Hawks|Sharks|Dragons|Warriors|Panthers|Wolves|Bears|Colts|Cubs|Rangers|Athletic"
CLUBS = "club society scouts guides brownies cubs troop squad academy"
LANDMARKS = "park library mosque church chapel temple synagogue gurdwara station centre center hall bridge market square gardens? playground pool baths"
#: Number words of several languages.
NUMBERS_ABROAD = """
zero oh one two three four five six seven eight nine cero uno dos tres cuatro cinco seis siete ocho nueve zéro un deux trois quatre cinq sept
huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante null eins zwei drei vier fünf funf sechs
sieben acht neun due tre quattro cinque sei sette otto nove nul een twee drie vijf zes zeven negen um dois três quatro sete oito ноль нуль
один два три четыре пять шесть семь восемь девять
"""
#: Fixed values: "dot" and "at" of several languages, titles, and words at which a name has ended.
DOTS, ATS = either("dot punto point punkt punt ponto точка"), either("at arroba arobase chiocciola apenstaartje собака")
TITLES_ABROAD = either("señorita senyorita señor senyor señora senyora doctora madame monsieur docteur docteure frau herr doktor maestra maestro dottor dottoressa juf meester dokter doutor doutora professora")
NAME_ABROAD = rf"(?!{either('and how is she he it the my your y e et und en es est elle il ist sie hij zij ela ele ha has')}\b)[\w'-]+"
#: What the checks ask for around or within a match.
PLACE_WORDS = frozenset("a an the town city village hamlet suburb area estate street road lane close avenue house home flat apartment bungalow maisonette caravan block council countryside country side centre center middle north south east west england scotland wales ireland uk britain here there nearby locally together alone school hospital".split())
AFTER_PLACE = frozenset("last this next ago again now then when because and but so with for from before after during since while year years month months week weeks summer winter term".split())
SCHOOL_MODIFIERS = frozenset("the a an my our his her their its big new old same another local little main that this other nearby usual".split())
MAIL_HOSTS = re.compile("(?i)@(?:gmail|yahoo|hotmail|outlook|icloud)")
NOT_AGE = re.compile(r"\s*(?:o'?clock|am|pm|p\.m|a\.m|minutes?|seconds?|hours?|pounds?|dollars?|percent|times?)")
NOT_SCHOOL = re.compile(r"(?i)(?:the|a|an|my|our|his|her|school|bed|sleep|work)\b")

#: Words that matches of the patterns above hold whole, for ``Rule.words``.
W_NUMBER = frozenset(re.findall(r"\w+", (ONES + " " + TENS).replace("?:", "")))
W_ORDINAL = frozenset(re.findall(r"[a-z]+", ORDINAL.split(")?", 1)[1].replace("?:", "")))
W_STREET = frozenset(STREETS.replace("gardens?", "garden gardens").split())
W_SCHOOL = frozenset("school academy college primary secondary nursery preschool pre kindergarten daycare day montessori grammar elementary institute".split())
W_TEAM = frozenset("fc f united rovers tigers lions eagles hawks sharks dragons warriors panthers wolves bears colts cubs rangers athletic".split())
W_ABROAD = frozenset(NUMBERS_ABROAD.split())
W_TITLE = frozenset("doctor dr mister mr miss ms mrs professor".split())
W_TITLE_ABROAD = frozenset(re.findall(r"\w+", TITLES_ABROAD.replace("?:", "")))
W_DOT = frozenset({"dot"})

Verdict = tuple[str, float, int] | None  # entity, score and end, or dropped


class _Runs:
    """Finds ``\\b[\\w and signs]+`` and then a pattern that starts with none of them.

    A run is entered once, not at each of its words: where the pattern fails
    after it, it fails from every place in it.
    """

    def __init__(self, signs: str, rest: re.Pattern):
        self.run, self.rest = re.compile(rf"[\w{re.escape(signs)}]++"), rest

    def finditer(self, text: str) -> Iterator[_Met]:
        at = 0
        while run := self.run.search(text, at):
            lo, at = run.span()
            # right after a word, which only a match before leaves, a sign is a start too
            after_word = lo > 0 and _WORD_CHAR.match(text, lo - 1)
            first = run if after_word else _WORD_CHAR.search(text, lo, at)
            if first and (met := self.rest.match(text, at)):
                at = met.end()
                yield _Met(first.start(), at)


_WORD_CHAR = re.compile(r"\w")


@dataclass(slots=True)
class _Met:
    first: int
    past: int

    def span(self, group: int = 0) -> tuple[int, int]:
        return self.first, self.past


@dataclass(frozen=True)
class Rule:
    name: str
    entity: str
    score: float
    pattern: str
    needs: str = ""
    value: bool = False
    check: Callable[[str, int, int, str, float], Verdict] | None = None
    ignore_case: bool = True
    signs: str = ""  # a run of word characters and these comes before the pattern
    words: tuple[frozenset[str], ...] = ()  # of each set a match has a word
    find: re.Pattern | _Runs = field(init=False, compare=False)

    def __post_init__(self):
        pattern = re.compile(self.pattern, re.I if self.ignore_case else 0)
        object.__setattr__(self, "find", _Runs(self.signs, pattern) if self.signs else pattern)

    def __reduce__(self):
        return Rule, (self.name, self.entity, self.score, self.pattern, self.needs, self.value, self.check, self.ignore_case, self.signs, self.words)


def _before(text: str, at: int, size: int, words: str) -> bool:
    return bool(re.search(rf"\b(?:{words})\b", text[max(0, at - size) : at].lower()))


def _card(text, lo, hi, entity, score):
    n = sum(map(str.isdecimal, text[lo:hi]))
    if not 13 <= n <= 19:
        return None
    return (entity, 0.97, hi) if luhn_ok(text[lo:hi]) else ("ACCOUNT_ID", 0.5, hi)


def _nhs(text, lo, hi, entity, score):
    return (entity, 0.95, hi) if _before(text, lo, 40, "nhs|patient|medical|health") else ("PHONE", 0.6, hi)


def _plate(text, lo, hi, entity, score):
    return (entity, 0.9, hi) if _before(text, lo, 40, r"car|van|plate|registration|reg|vehicle|number\s?plate") else None


def _zip(text, lo, hi, entity, score):
    return (entity, 0.9, hi) if _before(text, lo, 30, r"zip|postcode|postal|post\s?code") else None


def _digits(text, lo, hi, entity, score):
    return (entity, score, hi) if sum(map(str.isdecimal, text[lo:hi])) >= 9 else None


def _handle(text, lo, hi, entity, score):
    return None if MAIL_HOSTS.match(text, lo) else (entity, score, hi)


def _said_email(text, lo, hi, entity, score):
    return (entity, score, hi) if " at " in text[lo:hi].lower() else None


def _age(text, lo, hi, entity, score):
    age = spoken_cardinal(text[lo:hi])
    after = text[hi : hi + 24].lower()
    if age is None or age > 120 or NOT_AGE.match(after):
        return None
    if age <= 12 and re.search(r"\b(?:at|around|about|by|until|till)\s*$", text[max(0, lo - 40) : lo].lower()):
        return None  # a time of day
    return entity, 0.85 if re.match(r"\s*(?:years?\s*old|yrs?)", after) else score, hi


def _named_street(text, lo, hi, entity, score):
    return None if re.match(r"(?i)\s*(?:the|a|an|my|our|his|her)\b", text[lo:hi]) else (entity, score, hi)


def _low_school(text, lo, hi, entity, score):
    plain = SCHOOL_MODIFIERS | set(SCHOOLS_LOW.split())
    return (entity, score, hi) if any(normalize(w) not in plain for w in text[lo:hi].split()) else None


def _school_after(text, lo, hi, entity, score):
    own = text[lo:hi].strip()
    return None if len(own.split()) > 5 or NOT_SCHOOL.match(own) else (entity, 0.45, hi)


def _city(text, lo, hi, entity, score):
    words = list(re.finditer(r"[\w'-]+", text[lo:hi]))
    if not 1 <= len(words) <= 2 or any(normalize(w[0]) in PLACE_WORDS for w in words):
        return None
    # "bradford last year": the place is the first word
    return entity, score, lo + words[0].end() if normalize(words[-1][0]) in AFTER_PLACE and len(words) == 2 else hi


#: Name, entity, score and pattern of each rule.
RULES = [
    Rule("email", "EMAIL", 0.99, r"@[\w-]+(?:\.[\w-]+)+\b", "@", signs=".!#$%&'*+/=?^`{|}~-"),
    Rule("email_spoken", "EMAIL", 0.9, rf"(?:\s+{SIGN}\s+[\w.'-]+)*\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+\b", "dot", check=_said_email, signs=".'-", words=(W_DOT,)),
    Rule("url", "URL", 0.97, r"\b(?:https?://|www\.)[^\s<>\"')]+", "http www."),
    Rule("url_spoken", "URL", 0.85, r"\b(?:www|double\s+u\s+double\s+u\s+double\s+u)\s+dot\s+[\w-]+(?:\s+dot\s+[\w-]+)+\b", "dot", words=(W_DOT,)),
    Rule("ipv4", "IP_ADDRESS", 0.97, rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", "0"),
    Rule("ipv6", "IP_ADDRESS", 0.95, r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", ":"),
    Rule("mac", "MAC_ADDRESS", 0.97, r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", ": -"),
    Rule("iban", "IBAN", 0.9, r"(?-i:\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b)", "0"),
    Rule("us_ssn", "NATIONAL_ID", 0.97, r"\b\d{3}-\d{2}-\d{4}\b", "-"),
    Rule("uk_nhs", "MEDICAL_ID", 0.55, r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b", "0", check=_nhs),
    Rule("uk_ni", "NATIONAL_ID", 0.9, r"(?-i:\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b)", "0"),
    Rule("passport", "PASSPORT", 0.9, rf"\bpassport\s*(?:number|no\.?|#)?\s*[:=]?\s*({CODE})\b", "passport", True),
    Rule("plate_uk", "LICENSE_PLATE", 0.6, r"(?-i:\b[A-Z]{2}\d{2}\s?[A-Z]{3}\b)", "0", check=_plate),
    Rule("card", "CREDIT_CARD", 0.55, r"\b(?:\d[ -]?){13,19}\b", "0", check=_card),
    Rule("secret", "SECRET", 0.9, r"\b(?:password|passcode|pin(?:\s*code)?|api[ _-]?key|secret|token)\s*(?:is|=|:)\s*[\"']?([^\s\"',.;]{3,64})", "pass pin key secret token", True),
    Rule("phone_intl", "PHONE", 0.95, r"(?<![\w.])\+\d{1,3}[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?){2,5}\d{2,4}(?![\w])", "+"),
    Rule("phone_pairs", "PHONE", 0.9, r"(?<![\w.])0\d(?:[\s.-]\d{2}){4}(?![\w])", "0"),
    Rule("phone_local", "PHONE", 0.9, r"(?<![\w.])(?:\(?0\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}|\d{3}[\s.-]\d{3}[\s.-]\d{4}|\(\d{3}\)\s?\d{3}[\s.-]?\d{4})(?![\w])", "0", check=_digits),
    Rule("handle", "SOCIAL_HANDLE", 0.9, r"(?<![\w@])@[A-Za-z][\w.]{2,29}\b", "@", check=_handle),
    Rule("username_ctx", "ONLINE_USERNAME", 0.85, r"\b(?:username|user\s*name|handle|gamertag|screen\s*name|login|user\s*id)\s*(?:is|:|=)?\s+([A-Za-z0-9_.-]{3,32})\b", "user handle gamertag screen login", True),
    Rule("username_spoken", "ONLINE_USERNAME", 0.85, rf"\b(?:username|user\s*name|gamertag|screen\s*name|login|user\s*id|account)\s*(?:is|:|=)?\s+({PART}{{2,32}}(?:\s+{SIGN}\s+{PART}{{1,32}})+)", "user gamertag screen login account", True),
    Rule("handle_spoken", "SOCIAL_HANDLE", 0.7, rf"\bat\s+{PART}{{2,20}}(?:\s+(?:dot|dash)\s+{PART}{{2,20}})*(?:\s+underscore\s+{PART}{{2,20}})+(?:\s+(?:dot|dash|underscore)\s+{PART}{{2,20}})*", "underscore"),
    Rule("student_id", "STUDENT_ID", 0.9, rf"\b(?:student|pupil|admission|enrol(?:l)?ment|roll|register|upn)\s*{NUMBERED}{IS}\s*([\w-]{{3,20}})\b", "student pupil admission enrol roll register upn", True),
    Rule("account_id", "ACCOUNT_ID", 0.88, rf"\b(?:account|customer|reference|policy|case|member(?:ship)?|order|booking|ticket)\s*(?:id|number|no\.?|#|code){IS}\s*([\w-]{{3,24}})\b", "account customer reference policy case member order booking ticket", True),
    Rule("medical_id", "MEDICAL_ID", 0.88, rf"\b(?:nhs|medicare|medicaid|patient|medical\s*record|mrn|chart|insurance)\s*{NUMBERED}{IS}\s*([\w-]{{3,20}})\b", "nhs medic patient mrn chart insurance", True),
    Rule("street_full", "STREET_ADDRESS", 0.85, rf"\b(?:{UNIT}\s*\d+[a-z]?\s*,?\s*)?\d{{1,4}}[a-z]?\s+(?:{CAP}\s+){{0,3}}{STREET}\b\.?", "0", words=(W_STREET,)),
    Rule("street_spoken", "STREET_ADDRESS", 0.6, rf"\b{NUMBER}\s+(?:[\w'-]+\s+){{0,2}}{STREET}\b", words=(W_NUMBER, W_STREET,)),
    Rule("street_named", "STREET_ADDRESS", 0.5, rf"\b(?:{CAP}\s+){{1,3}}(?-i:{either(STREETS.title())})\b", check=_named_street, words=(W_STREET,)),
    Rule("postcode_uk", "POSTCODE", 0.92, r"(?-i:\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b)", "0"),
    Rule("postcode_us", "POSTCODE", 0.4, r"\b\d{5}(?:-\d{4})?\b", "0", check=_zip),
    Rule("postcode_ca", "POSTCODE", 0.85, r"(?-i:\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b)", "0"),
    Rule("live_at", "HOME_ADDRESS", 0.6, rf"\b(?:we|i)\s+live\s+(?:at|on|in)\s+((?:{CAP}\s?){{1,4}}|\d{{1,4}}[^,.;\n]{{2,40}})", "live", True),
    Rule("date_numeric", "PRECISE_DATE", 0.9, rf"\b{DAY}[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)?\d{{2}}\b", "0"),
    Rule("date_iso", "PRECISE_DATE", 0.95, r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", "-"),
    Rule("date_written", "PRECISE_DATE", 0.85, rf"\b(?:{DAY}{NTH}\s+(?:of\s+)?{MONTH}|{MONTH}\s+{DAY}{NTH})(?:,?\s+(?:19|20)\d{{2}})?\b", "0"),
    Rule(
        "dob_ctx",
        "DATE_OF_BIRTH",
        0.92,
        rf"\b(?:date\s+of\s+birth|d\.?o\.?b\.?|born\s+on|birthday\s+is){IS}\s*"
        rf"((?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}})|(?:\d{{1,2}}{NTH}\s+(?:of\s+)?{MONTH}(?:,?\s+(?:19|20)?\d{{2}})?)|(?:{MONTH}\s+\d{{1,2}}{NTH}(?:,?\s+(?:19|20)?\d{{2}})?)|(?:(?:19|20)\d{{2}}-\d{{2}}-\d{{2}})|(?:{DATE_SAID}))",
        "birth d o.b born",
        True,
    ),
    Rule("date_spoken", "PRECISE_DATE", 0.8, rf"\b{DATE_SAID}\b", "of", words=(W_ORDINAL,)),
    Rule("time_clock", "PRECISE_TIME", 0.85, rf"\b(?:[01]?\d|2[0-3])[:.][0-5]\d\s?{AMPM}?\b", "0"),
    Rule("time_ampm", "PRECISE_TIME", 0.8, rf"\b(?:1[0-2]|0?[1-9])\s?{AMPM}\b", "0"),
    Rule("time_spoken", "PRECISE_TIME", 0.8, rf"\b{either('quarter half ten twenty five twenty-five')}\s+(?:past|to|after)\s+{either('one two three four five six seven eight nine ten eleven twelve')[:-1]}|\d{{1,2}})\b", "past to after"),
    Rule("age_digit", "EXACT_AGE", 0.7, r"\b(?:(?:i'?m|im|i am|he'?s|she'?s|they'?re|is|was|aged?|turning|turns?)\s+)(\d{1,2})(?![\d/.:-])(?:\s*(?:years?\s*old|yrs?|y/?o))?\b", "0", True, _age),
    Rule("age_years", "EXACT_AGE", 0.9, r"\b(\d{1,2})\s*(?:years?\s*old|yrs?\s*old|y/?o)\b", "0", True),
    Rule("age_word", "EXACT_AGE", 0.6, rf"\b(?:(?:i'?m|im|i am|he'?s|she'?s|(?:\w+)\s+(?:is|was)|aged?|turning|turns?)\s+)((?:twenty[\s-])?(?:{ONES[3:-1]}|twenty))(?:\s*years?\s*old)?\b", "", True, _age, words=(W_NUMBER,)),
    Rule("year_group", "CLASS_NAME", 0.6, r"\b(?:year|grade|class|form)\s+(?:\d{1,2}|(?-i:[A-Z])\b|one|two|three|four|five|six)|\breception\s+class\b", "year grade class form"),
    Rule("school_named", "SCHOOL_NAME", 0.8, rf"(?-i:\b(?:[A-Z][\w'&-]+\s+){{1,4}}(?:{SCHOOLS})\b)", words=(W_SCHOOL,)),
    Rule("school_lower", "SCHOOL_NAME", 0.5, rf"\b(?:at|to|from|in|attends?|enrolled\s+at)\s+((?:[\w'&-]+\s+){{1,3}}{either(SCHOOLS_LOW)})\b", SCHOOLS_LOW, True, _low_school),
    Rule("school_ctx", "SCHOOL_NAME", 0.4, rf"\b(?:goes?\s+to|attends?|starts?\s+at|enrolled\s+(?:at|in)|transferred\s+to)\s+((?:{CAP}\s?){{1,4}})\b", "go attend start enrolled transferred", True, _school_after),
    Rule("team_named", "SPORTS_TEAM", 0.7, rf"(?-i:\b(?:[A-Z][\w'-]+\s+){{1,2}}(?:{TEAMS})\b)", words=(W_TEAM,)),
    Rule("team_ctx", "SPORTS_TEAM", 0.65, rf"\b(?:under[\s-]?\d{{1,2}}|u\d{{1,2}})s?\s+((?:{CAP}\s?){{1,2}})", "0", True),
    Rule("club_lower", "CLUB_NAME", 0.5, rf"\b(?:at|joins?|joined|goes?\s+to|attends?|plays?\s+for|member\s+of|training\s+at)\s+((?:the\s+)?(?:[\w'-]+\s+){{1,3}}{either(CLUBS)})\b", CLUBS, True),
    Rule("landmark_lower", "LOCAL_LANDMARK", 0.5, rf"\b(?:near|opposite|behind|next\s+to|beside|across\s+from|by)\s+((?:the\s+)?(?:[\w'-]+\s+){{1,3}}{either(LANDMARKS)})\b", LANDMARKS.replace("?", "").replace("gardens", "garden"), True),
    Rule("city_lower", "CITY", 0.5, r"\b(?:we|i|they|she|he)\s+(?:live|lives|lived|moved|grew\s+up)\s+(?:in|to|from|near)\s+((?:[\w'-]+)(?:\s+[\w'-]+)?)\b", "live moved grew", True, _city),
    Rule("bus_route", "BUS_ROUTE", 0.7, r"\b(?:(?:the\s+)?(?:number\s+)?\d{1,3}\s+bus|bus\s+(?:number\s+)?\d{1,3}|route\s+\d{1,3})\b", "bus route"),
    Rule("multilingual_spoken_phone", "PHONE", 0.96, rf"(?<!\w){either(NUMBERS_ABROAD)}(?:[ \t,-]+{either(NUMBERS_ABROAD)}){{6,}}(?!\w)", words=(W_ABROAD,)),
    Rule("multilingual_spoken_email", "EMAIL", 0.96, rf"(?:[ \t]+{DOTS}[ \t]+[\w.'-]+)*[ \t]+{ATS}[ \t]+[\w-]+(?:[ \t]+{DOTS}[ \t]+[\w-]+)+\b", "dot punto point punkt punt ponto точка", signs=".'-"),
    Rule("spoken_initial_name", "PERSON_NAME", 0.92, r"\b(?:doctor|dr|mister|mr|miss|ms|mrs|professor)[ \t]+[a-z][ \t]+[a-z]{2,20}\b", "do dr mi mr ms pro", words=(W_TITLE,)),
    Rule("multilingual_titled_name", "PERSON_NAME", 0.9, rf"\b(?:(?:la|el|le|il|lo|a|o)[ \t]+)?{TITLES_ABROAD}[ \t]+{NAME_ABROAD}(?:[ \t]+{NAME_ABROAD}){{0,2}}", "señor senyor doctor madame monsieur docteur frau herr doktor maestr dottor juf meester dokter doutor professora", words=(W_TITLE_ABROAD,)),
]
RULE_NAMES = [r.name for r in RULES]


class _Words:
    """A text's letters as a pattern without case takes them, and its words."""

    def __init__(self, text: str):
        low = text.casefold()
        self.low = low if low.isascii() else low.replace("i̇", "i").replace("ı", "i")
        self.digit = any(map(str.isdecimal, text))
        self.all = re.findall(r"\w+", self.low)
        self.distinct = frozenset(self.all)

    def may_meet(self, rule: Rule) -> bool:
        needs = rule.needs.split()
        if needs and not any(self.digit if x == "0" else x in self.low for x in needs):
            return False
        return not any(self.distinct.isdisjoint(w) for w in rule.words)


def scan(text: str, rules: list[Rule], detector: str = "rules", own: _Words | None = None) -> Iterator[Claim]:
    """Claims of ``rules`` on a text."""
    words = own or _Words(text)
    for rule in rules:
        if not words.may_meet(rule):
            continue
        for m in rule.find.finditer(text):
            own = 1 if rule.value and m.end(1) > m.start(1) else 0
            lo, hi = m.span(own)
            if not text[lo:hi].strip():
                continue
            verdict = rule.check(text, lo, hi, rule.entity, rule.score) if rule.check else (rule.entity, rule.score, hi)
            if verdict and verdict[2] > lo:
                yield Claim(lo, verdict[2], verdict[0], verdict[1], detector, rule.name)


_DIGIT_RUN = re.compile(rf"\b{DIGIT}(?:[\s,-]+{DIGIT}){{5,}}\b", re.I)
_DIGIT_SAID = frozenset("zero oh nought naught one two three four five six seven eight nine double triple treble".split())
_CODE_UNIT = rf"(?:[a-z]|{NUMBER}|hundred|thousand|double|triple|oh|zero|nought|\d{{1,4}})"
_CODE_RUN = re.compile(rf"\b{_CODE_UNIT}(?:[\s,-]+{_CODE_UNIT}){{4,}}\b", re.I)
#: Words before a run and what they make of it.
_RUN_CUES = [(r"\b(?:account|reference|policy|card|member|customer|order)\b", "ACCOUNT_ID", 0.8), (r"\b(?:number|phone|mobile|cell|call|reach|text)\b", "PHONE", 0.9)]
_CODE_CUES = [(r"post\s*code|postal\s*code|zip", "POSTCODE", 0.85), (r"pupil|student|admission|enrol|upn|roll", "STUDENT_ID", 0.85), (r"nhs|patient|medical|hospital", "MEDICAL_ID", 0.85), (r"account|reference|policy|membership|booking|case", "ACCOUNT_ID", 0.85)]


def _cued(text: str, at: int, size: int, cues: list, otherwise: tuple[str, float]) -> tuple[str, float]:
    before = text[max(0, at - size) : at].lower()
    return next(((entity, score) for cue, entity, score in cues if re.search(cue, before)), otherwise)


def spoken_runs(text: str, detector: str = "rules", own: _Words | None = None) -> Iterator[Claim]:
    """Numbers dictated digit by digit, and codes spelled letter by letter."""
    said = (own or _Words(text)).all
    digits = sum(w in _DIGIT_SAID or w.isdigit() for w in said)
    letters = sum(len(w) == 1 and w.isalpha() for w in said)
    for m in _DIGIT_RUN.finditer(text) if digits >= 6 else ():
        words = [w for w in re.split(r"[\s,-]+", m[0]) if w]
        digits = len(spoken_digits(words))
        said = sum(w.lower() in DIGIT_WORDS or w.lower() in TIMES_WORDS or w.isdigit() for w in words)
        if said >= 6 and digits >= 6:
            entity, score = _cued(text, m.start(), 32, _RUN_CUES, ("PHONE", 0.8 if digits >= 9 else 0.75))
            yield Claim(m.start(), m.end(), entity, score, detector, "spoken_digits")
    for m in _CODE_RUN.finditer(text) if letters >= 2 else ():
        words = re.findall(r"\w+", m[0])
        if len(words) >= 5 and sum(len(w) == 1 and w.isalpha() for w in words) >= 2:
            entity, score = _cued(text, m.start(), 60, _CODE_CUES, ("ACCOUNT_ID", 0.6))
            yield Claim(m.start(), m.end(), entity, score, detector, "spelled_code")


def user_rules(specs: list[dict]) -> list[Rule]:
    """Rules of the settings: name, pattern, entity, score, ignore_case."""
    return [Rule(s.get("name", "custom"), s["entity"], float(s.get("score", 0.9)), s["pattern"], ignore_case=bool(s.get("ignore_case"))) for s in specs or ()]


def claims(text: str, extra: list[Rule] = (), detector: str = "rules") -> list[Claim]:
    own = _Words(text)
    return [*scan(text, [*RULES, *extra], detector, own), *spoken_runs(text, detector, own)]


def detections(convs: DataFrame, find: Callable[[str], list[Claim]]) -> DataFrame:
    """A row for each claim of ``find`` on ``convs`` (conv_id, text); null texts have none."""
    names = ["conv_id", "detector", "raw_label", "entity", "start", "end", "score", "channel", "surface"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for conv_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(conv_id, c.detector, c.label, c.entity, c.start, c.end, c.score, c.channel, text[c.start : c.end]) for c in find(text or "")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spread(convs.select(F.col("conv_id").cast("string"), F.col("text").cast("string"))).mapInArrow(run, DETECTION)


def detect_rules(convs: DataFrame, extra: list[dict] = (), names: list[str] | None = None) -> DataFrame:
    """Detections of ``convs`` (conv_id, text) by the rules, or by those of ``names`` alone."""
    if names is not None:
        own = [r for r in RULES if r.name in names]
        return detections(convs, lambda text: list(scan(text, own)))
    more = user_rules(extra)
    return detections(convs, lambda text: claims(text, more))
