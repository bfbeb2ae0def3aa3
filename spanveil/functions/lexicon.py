"""Word lists of the detectors: fixed values, stated plainly; longer lists come from rules or as parameters."""

from __future__ import annotations

from .plain import normalize

#: Words with which a capital says nothing: pronouns, articles, auxiliaries, talk.
PLAIN_WORDS = """
i i'm im i've id ill the a an and but or so then now well yes no okay ok oh ah um uh erm hmm yeah yep nope right sure maybe just really
very too also because if when where what who why how which that this these those there here he she it they we you my your his her their
our its good bad nice great cool fine sorry thanks thank please hello hi hey bye goodbye let can could would should will shall must might
do does did done have has had be been being am are was were not don't didn't can't won't isn't it's that's what's there's let's dont didnt
cant wont isnt thats whats theres lets next last other another some any all both each every none more most much many few mine yours ours
hers them theirs him us himself herself
""".split()
#: Kin, people and topics that open sentences in such talk.
TOPIC_WORDS = """
mum mummy mom mommy dad daddy papa mama nan nana nanny granny grandma grandad grandpa brother sister baby son daughter kid kids child
children boy girl man woman people friend friends teacher teachers doctor nurse coach school class homework reading writing maths math
spelling science history geography art music drama swimming football soccer rugby cricket netball basketball gymnastics dancing dance karate
lunch lunchtime dinner breakfast tea snack playtime break assembly registration nursery reception classroom playground bus car bedtime bath
story holiday holidays birthday party christmas easter ramadan eid diwali hanukkah therapy session appointment medicine tablet inhaler
asthma allergy speech language
""".split()
#: Adverbs, conjunctions and the like that open sentences.
OPENING_WORDS = """
sometimes usually often always never rarely seldom occasionally normally generally perhaps possibly probably certainly definitely apparently
obviously clearly actually basically honestly frankly personally recently lately currently previously initially finally eventually suddenly
immediately meanwhile afterwards otherwise anyway however although though since unless until whenever wherever whereas therefore besides
moreover furthermore instead nevertheless nonetheless tonight whether after before during between around through above below under over
here's while whom whose everyone everybody someone somebody anyone anybody no one nobody everything nothing anything something everywhere
anywhere somewhere
""".split()
#: Verbs, of which the inflected forms count too, and irregular pasts.
VERBS = """
go come see look watch play work live like love want need know think say tell ask talk speak walk run jump sit stand sleep eat drink read
write draw help start finish begin end take give get put pick drop call text ring visit meet leave arrive stay wait move turn open close win
lose learn teach study practise practice train ride drive bring send show wear buy pay cost feel seem sound become stop keep hold carry
laugh cry smile shout make
""".split()
PASTS = "got went came said told knew thought saw made took gave".split()
#: The calendar.
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april may june july august september october november december".split()
PARTS = "morning afternoon evening night week weekend".split()
COUNTS = "one two three four five six seven eight nine ten first second third".split()
RELATIVE_DAYS = "today tomorrow yesterday month year".split()


def inflected(verb: str) -> set[str]:
    """A verb with its regular forms, spelled loosely."""
    forms = {verb, *(verb + s for s in ("s", "es", "ed", "ing"))}
    if verb.endswith("e"):
        forms |= {verb[:-1] + "ing", verb + "d"}
    if verb.endswith("y"):
        forms |= {verb[:-1] + "ies", verb[:-1] + "ied"}
    return forms


STOP_CAPS = frozenset({*PLAIN_WORDS, *TOPIC_WORDS, *OPENING_WORDS, *PASTS, *COUNTS, *RELATIVE_DAYS, *(w + s for w in [*DAYS, *MONTHS, *PARTS] for s in ("", "s")), *(f for v in VERBS for f in inflected(v))})

#: Words after which a name has ended.
NAME_ENDS = """
and or but so then the a an my our your his her their its is are was were am be been to at in on of for from with by about into over under
after before because if when who that this these those there here goes go going went comes come came said says say told tells tell does do
did has have had will would can could should just really very not no yes okay ok well like got get gets takes take took picks pick picked
finishes finish finished starts start started works work worked plays play played lives live lived likes loves love wants want needs need
thinks think knows know too also always never sometimes usually today tomorrow yesterday now still again back up down out off all both each
every some any one two three four five
""".split()

#: Words of kin and role, by the entity of the name that goes with them.
ROLE_WORDS = {
    "PARENT_NAME": "mum mummy mom mommy mama mother dad daddy papa father stepmum stepdad",
    "SIBLING_NAME": "brother sister twin stepbrother stepsister",
    "RELATIVE_NAME": "grandma grandad grandpa granny nan nana auntie aunty aunt uncle cousin godmother babysitter childminder nanny sitter",
    "TEACHER_NAME": "teacher headteacher principal ta tutor keyworker",
    "THERAPIST_NAME": "therapist counsellor counselor psychologist",
    "DOCTOR_NAME": "doctor dr gp paediatrician pediatrician nurse dentist",
    "COACH_NAME": "coach instructor",
    "FRIEND_NAME": "friend bestfriend classmate",
    "PERSON_NAME": "neighbour neighbor",
}
#: Titles, by the entity of the name that follows.
TITLE_WORDS = {
    "PERSON_NAME": "mr mister mrs ms professor prof",
    "TEACHER_NAME": "miss sir",
    "DOCTOR_NAME": "dr doctor nurse",
    "COACH_NAME": "coach",
    "RELATIVE_NAME": "auntie aunty uncle",
}
ROLE_ENTITY = {w: e for e, words in ROLE_WORDS.items() for w in words.split()}
TITLE_ENTITY = {w: e for e, words in TITLE_WORDS.items() for w in words.split()}
#: Nouns of workplaces, and particles with which "runs out" names none.
VENUES = frozenset("""
bakery shop store supermarket market pharmacy chemist garage factory warehouse office bank hospital clinic surgery practice school college
university nursery restaurant cafe café takeaway pub bar hotel salon barbers barber gym studio depot depot's centre center library museum
theatre cinema station post airport farm workshop laboratory lab dealership motors haulage joinery plumbing council nhs hmrc firm agency
company ltd limited plc llp inc corporation charity
""".split())
PARTICLES = frozenset("out into up down off away back over under through around about along across".split())

#: Our own short list of first names; a longer one is a parameter (``gazetteer``).
FIRST_NAMES = frozenset("adam aisha alice amir amy ana anna arthur ava ben carlos chloe clara daniel david diego elena ella emily emma eric eva fatima felix freya george grace hannah harry hugo ibrahim isla ivan jack james jan jose julia karim kate laura leo liam lily lucas lucy maria marie mark max maya mia mohammed nina noah nora oliver olivia omar oscar paul peter priya ravi rosa ruby sam samira sara sofia sophie theo thomas tom victor yusuf zaid zara zoe".split())


def gazetteer(lines: list[str]) -> frozenset[str]:
    """Names of a list, several to a line; lines that start with # are remarks."""
    return frozenset(n for line in lines if not line.lstrip().startswith("#") for n in map(normalize, line.split()) if n)


#: Labels of speakers by role.
SPEAKER_LABELS = {
    "child": "child kid boy girl son daughter student pupil c minor",
    "parent": "parent mum mom mother mummy dad father daddy caregiver carer guardian adult p",
    "clinician": "doctor dr clinician therapist nurse counsellor counselor interviewer researcher assessor",
    "teacher": "teacher ta tutor",
    "sibling": "sibling brother sister",
}
LABEL_ROLE = {w: r for r, words in SPEAKER_LABELS.items() for w in words.split()}
#: Labels that name no one.
GENERIC_LABELS = frozenset({*"child kid boy girl son daughter student pupil minor parent mum mom mother mummy dad father daddy adult caregiver carer guardian doctor clinician therapist nurse interviewer researcher assessor teacher sibling brother sister unknown speaker".split(), "speaker unknown"})
#: Cues in speech by role, with weights.
CUES = {
    "child": [
        (r"(?i)\bmy (mum|mummy|mom|mommy|dad|daddy|teacher|miss|nan|nanny|granny)\b", 2.0),
        (r"(?i)\bi'?m (in )?(year|grade|reception|nursery)\b", 2.0),
        (r"(?i)\bat (school|nursery|playtime|break time|lunchtime)\b", 1.0),
        (r"(?i)\bi'?m ([0-9]|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b", 1.5),
        (r"(?i)\b(my toy|my teddy|playtime|homework|my best friend)\b", 1.0),
    ],
    "parent": [
        (r"(?i)\bmy (son|daughter|child|kid|boy|girl|little one|eldest|youngest)\b", 2.5),
        (r"(?i)\b(she|he|they) (goes|go|started|starts|attends) (to )?(school|nursery)\b", 1.5),
        (r"(?i)\b(i|we) (work|works|working)\b", 1.2),
        (r"(?i)\b(pick (him|her|them) up|drop (him|her|them) off|his teacher|her teacher)\b", 1.5),
        (r"(?i)\b(mortgage|nursery fees|appointment|gp|our address)\b", 1.0),
    ],
    "clinician": [
        (r"(?i)\b(can you tell me|how (does|did) that (make you )?feel|i'?m going to ask|on a scale of|next question|thank you for coming)\b", 2.0),
        (r"(?i)\b(the (assessment|session|appointment) (today|now))\b", 1.5),
    ],
}
#: Titles that speech recognition takes for one another.
HONORIFICS = {w: kind for kind, words in {"TITLE": "mr mister mrs ms miss sir madam maam", "TITLE_DR": "dr doctor prof professor nurse", "TITLE_C": "coach", "TITLE_T": "teacher", "TITLE_A": "auntie aunty aunt", "TITLE_U": "uncle"}.items() for w in words.split()}
#: Parts of names too general to stand for one.
GENERIC_PARTS = frozenset("""
school schools primary secondary academy college nursery preschool kindergarten daycare montessori grammar elementary institute university
club team squad fc united rovers hospital clinic centre center surgery practice park street road avenue lane drive close court crescent way
place terrace gardens house flat apartment the and of for
""".split())
