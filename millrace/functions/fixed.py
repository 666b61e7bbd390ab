"""Fixed values of the language: what the operators must agree on to give the right results.

Suffixes are in the order in which they are tried; the other lists are in their natural order.
"""

# Case endings, tried in this order.
SUFFIXES = (
    "ovými", "ových", "ovém", "ovou", "ové", "ová", "ova", "ovo", "ovi", "ovu", "ovy", "ého", "ému", "ými", "ých", "ích", "ém", "ům", "ách", "emi",
    "ami", "ou", "em", "ěm", "é", "á", "ý", "í", "ú", "ó", "e", "ě", "y", "u", "a", "o", "i",
)

# Endings that a first name loses, tried in this order.
NAME_SUFFIXES = ("ovi", "ovy", "ove", "ova", "em", "um", "y", "u", "a", "e", "i", "o")

# Long vowels and their short forms, vowels, the shortest stem, the vowel that declension drops.
LONG_VOWELS, SHORT_VOWELS = "áéíóúůýě", "aeiouuye"
VOWELS = "aeiouyáéíóúýěů"
MIN_STEM = 3
FLEETING_VOWEL = "e"

# Endings of a feminine name.
FEMININE_ENDINGS = ("ová", "á", "a")

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "mudr", "judr", "phdr", "rndr", "ing", "prof", "doc", "csc", "mgr", "bc", "tzv", "atd", "apod", "např", "tj", "mj", "tzn", "aj", "resp", "popř",
    "cca", "č", "r", "st", "sv", "kap", "obr", "tab", "roč", "s", "str", "stol",
)

# Function words that retrieval leaves out.
STOPWORDS = (
    "a", "aby", "aj", "ale", "ani", "ano", "az", "až", "bez", "bude", "budou", "by", "byl", "byla", "byli", "bylo", "být", "co", "což", "či", "do",
    "i", "je", "jeho", "jej", "její", "jejich", "jen", "ještě", "jak", "jako", "jsem", "jsi", "jsme", "jsou", "jste", "k", "kam", "kde", "kdo",
    "když", "ke", "která", "které", "který", "kteří", "ku", "ma", "má", "mají", "mé", "mezi", "mi", "mít", "mne", "mně", "můj", "my", "na", "nad",
    "nade", "nam", "nám", "napiš", "naš", "náš", "ne", "nebo", "něco", "něj", "není", "než", "ní", "nic", "o", "od", "on", "ona", "oni", "ono", "pak",
    "po", "pod", "podle", "pokud", "pouze", "proč", "pro", "před", "přes", "při", "s", "se", "si", "ta", "tak", "také", "tam", "te", "tě", "ten",
    "tedy", "to", "tom", "tomu", "tuto", "ty", "u", "už", "v", "vám", "vas", "vás", "ve", "více", "však", "všech", "vy", "z", "za", "ze", "že",
)

# Headings from which on an article is apparatus.
REFERENCE_HEADINGS = (
    "odkazy", "reference", "literatura", "externí odkazy", "související články", "související", "poznámky", "bibliografie", "prameny",
)

# Months, genitive and nominative, in the order of the year.
MONTHS = {
    "ledna": "leden", "února": "únor", "března": "březen", "dubna": "duben", "května": "květen", "června": "červen",
    "července": "červenec", "srpna": "srpen", "září": "září", "října": "říjen", "listopadu": "listopad", "prosince": "prosinec",
}

# Quotation marks that cling to a lemma.
LEMMA_QUOTES = "„“”‚’'\"»«›‹"

# Predicates that say what something is or goes with, not what happened.
IDENTITY = ("být", "druh")
NAMING = "jmenovat"
ASSOCIATION = "kontext"

# Words for numbers and operators, phrases that ask for a sum; folded letters.
NUMERALS = {
    "nula": 0, "jedna": 1, "jeden": 1, "jedno": 1, "dva": 2, "dve": 2, "tri": 3, "ctyri": 4, "pet": 5, "sest": 6, "sedm": 7, "osm": 8, "devet": 9, "deset": 10,
    "jedenact": 11, "dvanact": 12, "trinact": 13, "ctrnact": 14, "patnact": 15, "sestnact": 16, "sedmnact": 17, "osmnact": 18, "devatenact": 19,
    "dvacet": 20, "tricet": 30, "ctyricet": 40, "padesat": 50, "sedesat": 60, "sedmdesat": 70, "osmdesat": 80, "devadesat": 90,
    "sto": 100, "ste": 100, "sta": 100, "set": 100, "tisic": 1000, "tisice": 1000,
}
OPERATOR_WORDS = {"plus": "+", "minus": "-", "krat": "*", "deleno": "/", "lomeno": "/"}
SUM_PHRASES = ("dohromady", "celkem", "soucet", "soucty", "secti")

# What a consonant at a stem's end turns into; verbs and nouns of making things; verbs of movement.
PALATAL_FOLD = {"z": "h", "c": "k", "s": "ch", "š": "ch"}
WORK_VERBS = ("napsat", "vydat", "natočit", "složit", "namalovat", "vytvořit", "dokončit", "publikovat", "sepsat")
WORK_NOUNS = (
    "hra", "dílo", "kniha", "román", "povídka", "obraz", "film", "báseň", "sbírka", "drama", "text", "komedie", "novela", "tragédie", "publikace", "esej", "fejeton",
    "trilogie",
)
MOVEMENT = (
    "putovat", "cestovat", "pobývat", "dlít", "přespat", "přijít", "odejít", "vejít", "vyjít", "vystoupit", "odebrat", "jet", "přijet", "odjet", "letět", "přiletět",
    "odletět", "plout", "připlout", "odplout", "dorazit", "vrátit", "utéct", "prchnout", "stěhovat", "přestěhovat", "kráčet", "vandrovat",
)

# Nouns that only join, nouns that speak of words, words that ask.
FUNCTION_NOUNS = (
    "souvislost", "ohled", "rámec", "smysl", "důsledek", "základ", "závislost", "hledisko", "vztah", "případ", "míra", "způsob", "podoba", "forma", "řada",
)
METALANGUAGE_NOUNS = ("jméno", "slovo", "název", "pojmenování", "zkratka", "výraz", "označení")
INTERROGATIVE_PRONOUNS = ("jaký", "který", "kdo", "co", "čí", "kolik")

# The question word for an entity's kind, and the case that an answer to a question word takes.
QUESTION_OF = {"p": "Kdo", "g": "Kde", "i": "Co", "t": "Kdy", "n": "Kolik"}
ANSWER_CASE = {"Kdo": "1", "Co": "1", "Kde": "1", "Kdy": None, "Kolik": None, "Jaký": None, "Který": "1", "Čí": "1"}

# Words of time, without marks.
TIME_UNITS = {
    "minuta": "minute", "minutu": "minute", "minuty": "minute", "minut": "minute", "minutou": "minute", "minutami": "minute",
    "sekunda": "second", "sekundu": "second", "sekundy": "second", "sekund": "second", "vterina": "second", "vterinu": "second", "vteriny": "second", "vterin": "second",
    "hodina": "hour", "hodinu": "hour", "hodiny": "hour", "hodin": "hour", "hodinou": "hour", "hodinami": "hour",
    "den": "day", "dne": "day", "dni": "day", "dny": "day", "dnu": "day", "dnem": "day", "dnech": "day",
    "tyden": "week", "tydne": "week", "tydnu": "week", "tydnem": "week", "tydny": "week", "tydnech": "week",
    "mesic": "month", "mesice": "month", "mesici": "month", "mesicem": "month",
    "rok": "year", "roku": "year", "roce": "year", "rokem": "year", "roky": "year", "let": "year", "lety": "year", "letech": "year",
    "stoleti": "century", "stoletich": "century",
}
TIME_NUMERALS = {
    "jeden": 1, "jednu": 1, "jednou": 1, "jednim": 1, "jedne": 1, "dva": 2, "dve": 2, "dvema": 2, "tri": 3, "tremi": 3, "ctyri": 4, "ctyrmi": 4, "pet": 5, "peti": 5,
    "sest": 6, "sesti": 6, "sedm": 7, "sedmi": 7, "osm": 8, "osmi": 8, "devet": 9, "deviti": 9, "deset": 10, "deseti": 10,
    "jedenact": 11, "dvanact": 12, "patnact": 15, "dvacet": 20, "tricet": 30, "ctyricet": 40, "padesat": 50, "sedesat": 60,
}
MONTH_FORMS = {
    "ledna": 1, "unora": 2, "brezna": 3, "dubna": 4, "kvetna": 5, "cervna": 6, "cervence": 7, "srpna": 8, "zari": 9, "rijna": 10, "listopadu": 11, "prosince": 12,
    "lednu": 1, "unoru": 2, "breznu": 3, "dubnu": 4, "kvetnu": 5, "cervnu": 6, "cervenci": 7, "srpnu": 8, "rijnu": 10, "prosinci": 12,
}
MONTH_NAMES = {"leden": 1, "unor": 2, "brezen": 3, "duben": 4, "kveten": 5, "cerven": 6, "cervenec": 7, "srpen": 8, "zari": 9, "rijen": 10, "listopad": 11, "prosinec": 12}
DAY_WORDS = {"predevcirem": -2, "vcera": -1, "dnes": 0, "zitra": 1, "pozitri": 2}
NOW_WORDS = ("ted", "nyni", "prave")
NOW_WINDOW_MINUTES = 15
BACK_WORDS = ("pred",)
FORWARD_WORDS = ("za",)
CURRENT_WORDS = ("tento", "tuto", "toto", "tomto", "teto", "letos", "letosni")
THIS_YEAR_WORDS = ("letos", "letosni")
NEXT_WORDS = ("pristi", "nadchazejici")
LAST_WORDS = ("minuly", "minulem", "minulou", "minule", "predchozi", "predesly", "predeslem")
WEEKDAY_FORMS = {"pondeli": 0, "utery": 1, "streda": 2, "stredu": 2, "ctvrtek": 3, "patek": 4, "sobota": 5, "sobotu": 5, "nedele": 6, "nedeli": 6}
DAY_PARTS = {"rano": "07:00", "dopoledne": "10:00", "poledne": "12:00", "odpoledne": "15:00", "vecer": "19:00", "noc": "22:00"}
SOON_MINUTES = {"chvili": 15, "chvilku": 15, "moment": 5, "okamzik": 5}
FRACTION_MINUTES = {"ctvrt": 15, "pul": 30}
ADVANCE_WORDS = ("predem", "dopredu")
REMINDER_HOUR, AFTERNOON_FROM, EVENT_LEAD_HOURS, TODAY_LEAD_HOURS = 9, 7, 2, 3
TOMORROW_PART, HEADS_UP_PART = "rano", "vecer"
WEEKDAY_NAMES = ("pondělí", "úterý", "středa", "čtvrtek", "pátek", "sobota", "neděle")
MONTH_GENITIVES = ("ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince")
CLOCK_DAY = ("co je za den", "co je dnes za den", "jaky je den", "jaky je dnes den", "kolikateho je")
CLOCK_TIME = ("kolik je hodin", "kolik je prave hodin", "kolik je ted hodin")

# Question words without marks, each with the role and type that it asks for and its own name.
INTERROGATIVES = {
    "kdo": ("subj", "person", "Kdo"), "koho": ("obj", "person", "Kdo"), "co": ("obj", None, "Co"), "ceho": ("obj", None, "Co"), "cemu": ("obj", None, "Co"),
    "kde": ("loc", "geo", "Kde"), "kam": ("loc", "geo", "Kde"), "odkud": ("loc", "geo", "Kde"), "kdy": ("time", "time", "Kdy"), "kolik": ("num", "number", "Kolik"),
    "jaky": ("attr", None, "Jaký"), "jaka": ("attr", None, "Jaký"), "jake": ("attr", None, "Jaký"), "jakou": ("attr", None, "Jaký"), "jakeho": ("attr", None, "Jaký"), "jakem": ("attr", None, "Jaký"),
    "ktery": ("attr", None, "Který"), "ktera": ("attr", None, "Který"), "ktere": ("attr", None, "Který"), "kterou": ("attr", None, "Který"), "kterem": ("attr", None, "Který"),
    "ci": ("subj", "person", "Čí"), "cim": ("obj", None, "Čím"),
}
INTERROGATIVE_ADVERBS = ("proč", "jak", "kudy", "odkud", "nač", "zač", "kolikrát", "dokdy", "odkdy")
COPULA_FORMS = ("je", "byl", "byla", "bylo", "byli", "byly", "jsou", "byt", "jsem", "jsi", "jste", "jsme")
RELATIVE_PRONOUNS = ("ktery", "ktera", "ktere", "kteri", "jenz", "jez")
QUERY_SKIP_WORDS = ("se", "si", "v", "ve", "na", "o", "s", "z", "ze", "do", "pro", "u", "k", "ke", "po", "za", "pod", "nad", "pred", "pri", "ten", "ta", "to", "tento", "tato", "toto", "tomto", "teto")
DATE_PART_FORMS = {"rok": "rok", "roku": "rok", "roce": "rok", "letech": "rok", "mesic": "měsíc", "mesici": "měsíc", "den": "den", "dne": "den", "dni": "den"}
RELATIONAL_NOUNS = (
    "bratr", "sestra", "matka", "otec", "syn", "dcera", "rodič", "manžel", "manželka", "žena", "muž", "vnuk", "vnučka", "strýc", "teta", "přítel", "přítelkyně", "kolega",
    "žák", "učitel", "soused",
)
RELATION_NOUNS = ("vztah", "vztahu", "vztahy", "vazba", "vazbu", "spojeni", "souvislost")
FIRST_PERSON = ("jsem", "sem", "jsme")
USER = "uživatel"
NEGATION = "ne"
EVENT_VERB_FORMS = {
    "stalo": "stát", "stala": "stát", "stal": "stát", "staly": "stát", "deje": "dít", "delo": "dít", "udalo": "udát", "prihodilo": "přihodit", "rekl": "říci", "rekla": "říci",
    "rekli": "říci", "rekne": "říci", "reknou": "říci", "dela": "dělat", "delal": "dělat", "delala": "dělat", "delaji": "dělat", "zil": "žít", "zila": "žít", "zili": "žít",
    "prisel": "přijít", "prisla": "přijít", "prislo": "přijít", "prisli": "přijít",
}
EVENT_CLASS_FORMS = {"zazrak": "zázrak", "zazraky": "zázrak", "zazraku": "zázrak", "zazrakum": "zázrak", "zazracich": "zázrak"}

# Patterns that decide what a date, a heading, a range of dates and a licence envelope are.
DATE_NUMERIC = r"\b([12]?\d|3[01])\.\s?(1[0-2]|0?[1-9])\.\s?(1\d{3}|20\d{2})\b"
DATE_YEAR = r"\b(1\d{3}|20\d{2})\b"
DATE_DAY = r"\b([12]?\d|3[01])\.\s"
HEADING = r"^\s*=+\s*(.+?)\s*=+\s*$"
DATE_RANGE = r"\s*\([^()]*\b(?:1[5-9]\d\d|20\d\d)\b[^()]*[–—-][^()]*\)"
ENVELOPE_START = r"(?is)^.*?\*\*\*\s*START OF.*?\*\*\*"
ENVELOPE_END = r"(?is)\*\*\*\s*END OF.*"
