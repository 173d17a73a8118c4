"""Word lists and patterns that the rules match, in order of declaration.

A lexicon is a dict of class -> list of patterns; order decides ties. Patterns are regular expressions, matched without
regard to case. Lexicons of other languages are given by the caller (see sources.readers.read_lexicon).
"""

from __future__ import annotations

# Abstract roles.
ROLES = {
    "SELF": [r"\b(I|me|my|myself|mine)\b", r"\bone's own\b"],
    "OTHER": [
        r"\b(you|your|yours|yourself)\b",
        r"\b(they|them|their|theirs)\b",
        r"\b(he|him|his|she|her|hers)\b",
        r"\b(another|other|someone|anyone|person|people|individual)\b",
        r"\b(neighbor|neighbour|fellow)\b",
    ],
    "FAMILY": [
        r"\b(mother|father|parent|parents)\b",
        r"\b(son|daughter|child|children|kid|kids)\b",
        r"\b(brother|sister|sibling|siblings)\b",
        r"\b(husband|wife|spouse)\b",
        r"\b(grandfather|grandmother|grandparent)\b",
        r"\b(uncle|aunt|cousin|nephew|niece)\b",
        r"\b(family|relative|kin)\b",
    ],
    "AUTHORITY": [
        r"\b(rabbi|sage|teacher|master|rav)\b",
        r"\b(court|judge|beit din|sanhedrin)\b",
        r"\b(king|ruler|government|authority)\b",
        r"\b(God|Hashem|Lord|divine)\b",
        r"\b(boss|employer|supervisor)\b",
    ],
    "COMMUNITY": [r"\b(community|society|public|nation)\b", r"\b(Israel|people|congregation)\b", r"\b(group|organization|collective)\b"],
    "VULNERABLE": [r"\b(orphan|widow|poor|needy)\b", r"\b(stranger|convert|ger)\b", r"\b(sick|ill|injured|dying)\b", r"\b(child|infant|minor)\b"],
}

# Relations.
RELATIONS = {
    "HARM_PREVENTION": [
        r"\b(kill|murder|slay|put to death)\b",
        r"\b(harm|hurt|injure|damage|wound)\b",
        r"\b(save|rescue|protect|preserve)\b",
        r"\b(life|death|danger|peril|risk)\b",
        r"\b(blood|violence|strike|smite)\b",
    ],
    "RECIPROCITY": [
        r"\b(return|repay|restore|give back)\b",
        r"\b(owe|debt|obligation|due)\b",
        r"\b(equal|same|likewise|similarly)\b",
        r"\b(mutual|reciprocal|exchange)\b",
        r"\b(hateful|love|do unto)\b",
    ],
    "AUTONOMY": [
        r"\b(choose|decision|free will|liberty)\b",
        r"\b(consent|agree|accept|refuse)\b",
        r"\b(force|coerce|compel|require)\b",
        r"\b(right|entitle|privilege)\b",
        r"\b(self-determination|agency)\b",
    ],
    "PROPERTY": [
        r"\b(property|possession|belonging)\b",
        r"\b(own|ownership|owner)\b",
        r"\b(steal|theft|rob|take)\b",
        r"\b(buy|sell|trade|exchange)\b",
        r"\b(land|field|house|goods)\b",
        r"\b(lost|found|return)\b",
    ],
    "FAMILY": [
        r"\b(honor|respect|revere)\b.*\b(parent|father|mother)\b",
        r"\b(marry|marriage|betroth|wed)\b",
        r"\b(divorce|separate|put away)\b",
        r"\b(inherit|inheritance|heir)\b",
        r"\b(support|provide|sustain)\b.*\b(family|child|wife)\b",
    ],
    "AUTHORITY": [
        r"\b(obey|follow|heed|submit)\b",
        r"\b(command|decree|order|law)\b",
        r"\b(permit|allow|forbid|prohibit)\b",
        r"\b(judge|rule|decide|arbitrate)\b",
        r"\b(teach|instruct|guide)\b",
    ],
    "EMERGENCY": [
        r"\b(emergency|urgent|immediate)\b",
        r"\b(life-threatening|mortal danger)\b",
        r"\b(pikuach nefesh|save a life)\b",
        r"\b(override|supersede|set aside)\b",
        r"\b(Sabbath|shabbat|shabbos)\b.*\b(save|life)\b",
    ],
    "CONTRACT": [r"\b(promise|vow|oath|swear)\b", r"\b(agree|agreement|contract)\b", r"\b(commit|commitment|pledge)\b", r"\b(word|keep|break|fulfill)\b", r"\b(neder|shevua)\b"],
    "CARE": [r"\b(care|caring|tend|look after)\b", r"\b(help|assist|aid|support)\b", r"\b(feed|clothe|shelter|provide)\b", r"\b(visit|comfort|console)\b", r"\b(tzedakah|charity|give)\b"],
    "FAIRNESS": [r"\b(fair|just|justice|righteous)\b", r"\b(equal|equally|same|impartial)\b", r"\b(deserve|merit|earn|worthy)\b", r"\b(bias|favor|prejudice|partial)\b", r"\b(mishpat|din|tzedek)\b"],
}

# Normative states.
STATES = {
    "OBLIGATION": [r"\b(must|shall|have to|need to)\b", r"\b(obligat|duty|bound|require)\b", r"\b(command|mitzvah|chayav)\b", r"\b(responsible|accountable)\b"],
    "RIGHT": [r"\b(right to|entitled|may claim)\b", r"\b(deserve|owed|due)\b", r"\b(demand|expect|require from)\b"],
    "LIBERTY": [r"\b(may|can|permitted|allowed)\b", r"\b(free to|liberty to|privilege)\b", r"\b(optional|voluntary|choice)\b", r"\b(mutar|reshut)\b"],
    "NO_RIGHT": [r"\b(cannot demand|no claim|not entitled)\b", r"\b(no right to|may not require)\b"],
}

# Consent, in order of precedence; IMPLICIT_YES where none matches.
CONSENT = {
    "EXPLICIT_YES": [r"\b(agree|agreed|consent|consented)\b", r"\b(accept|accepted|willing|willingly)\b", r"\b(yes|approve|approved)\b"],
    "EXPLICIT_NO": [r"\b(refuse|refused|reject|rejected)\b", r"\b(no|deny|denied|unwilling)\b", r"\b(against|oppose|opposed)\b"],
    "CONTESTED": [
        r"\b(dispute|disputed|disagree)\b",
        r"\b(debate|debated|argue|argued)\b",
        r"\b(machlok|machloket|controversy)\b",
        r"\b(some say|others say|one says)\b",
        r"\b(Rabbi \w+ says.*Rabbi \w+ says)\b",
    ],
    "IMPOSSIBLE": [r"\b(future generation|unborn)\b", r"\b(animal|beast|creature)\b", r"\b(deceased|dead|departed)\b", r"\b(cannot consent|unable to agree)\b"],
}

# Consensus.
DISPUTE = [r"\bdispute[ds]?\b", r"\bdisagree[ds]?\b", r"\bmachlok", r"\bdebate[ds]?\b", r"Rabbi \w+ says", r"\bsome say\b", r"\bothers say\b", r"\bone opinion\b", r"\banother view\b"]
UNIVERSAL = [r"\beveryone agrees\b", r"\bundisputed\b", r"\buniversally\b", r"\balways\b", r"\bnever\b.*\b(kill|murder|steal)\b", r"save[s]? a life", r"pikuach nefesh", r"love your neighbor", r"golden rule"]

# Topics of letters, in order of precedence; "general" where none matches.
TOPICS = {
    "family": [r"\b(mother|father|parent|sibling|brother|sister|child|daughter|son|family|mom|dad)\b"],
    "marriage": [r"\b(husband|wife|spouse|married|wedding|divorce|marriage)\b"],
    "relationship": [r"\b(boyfriend|girlfriend|dating|relationship|partner|romance)\b"],
    "work": [r"\b(boss|coworker|job|work|office|employee|career|colleague)\b"],
    "neighbor": [r"\b(neighbor|neighbourhood|community)\b"],
    "friendship": [r"\b(friend|friendship|buddy|pal)\b"],
    "money": [r"\b(money|debt|loan|inherit|financial|pay|owe)\b"],
    "health": [r"\b(doctor|health|medical|illness|sick|disease)\b"],
    "etiquette": [r"\b(rude|polite|manner|etiquette|proper|thank)\b"],
}

# Modal words by class, in order of precedence, and the state of each class.
MODALS = {
    "obligation": ["must", "shall", "have to", "ought to", "need to", "required", "obligated"],
    "permission": ["may", "can", "allowed", "permitted", "free to", "entitled"],
    "prohibition": ["must not", "shall not", "cannot", "forbidden", "prohibited", "banned"],
    "supererogation": ["should", "ought", "would be good", "ideally", "preferably"],
}
MODAL_STATE = {"obligation": "OBLIGATION", "permission": "LIBERTY", "prohibition": "NO_RIGHT", "supererogation": "LIBERTY", "unknown": "OBLIGATION"}
NEGATIONS = ["not", "no", "never", "neither", "nor", "n't", "without", "lack", "none"]

# Gates, as (kind, pattern, trigger, confidence, language). Binding: L to O; release: O to L.
GATES = [
    ("binding", r"\b(must|shall|obligat|requir|command|bound)\b", "obligation_marker", 0.85, "en"),
    ("binding", r"\b(vow|oath|swear|swore|sworn|promise)\b", "vow_marker", 0.92, "en"),
    ("binding", r"\b(forbidden|prohibit|may not|cannot)\b", "prohibition_marker", 0.88, "en"),
    ("binding", r"\b(duty|duties|responsible|liability)\b", "duty_marker", 0.82, "en"),
    ("release", r"\b(permitted|allow|may|exempt|free|release)\b", "permission_marker", 0.85, "en"),
    ("release", r"\b(annul|void|nullif|cancel)\b", "annulment_marker", 0.90, "en"),
    ("release", r"\b(forgive|waive|relinquish)\b", "forgiveness_marker", 0.88, "en"),
    ("release", r"\b(coerce|force|duress|compel)\b", "coercion_nullifier", 0.92, "en"),
    ("nullifier", r"\b(abuse|abus|violent|violence|harm|danger)\b", "abuse_nullifier", 0.95, None),
    ("nullifier", r"\b(pikuach nefesh|life.{0,10}danger|save.{0,5}life)\b", "life_danger", 0.98, None),
]
#: Scores of gates in English count less.
ENGLISH_WEIGHT = 0.8

# Periods in order, and their centuries.
PERIODS = ["BIBLICAL", "SECOND_TEMPLE", "TANNAITIC", "AMORAIC", "GEONIC", "RISHONIM", "ACHRONIM", "MODERN_HEBREW", "DEAR_ABBY"]
CENTURIES = {"BIBLICAL": -6, "SECOND_TEMPLE": -2, "TANNAITIC": 2, "AMORAIC": 4, "GEONIC": 8, "RISHONIM": 12, "ACHRONIM": 17, "MODERN_HEBREW": 20}
# Part of a category -> period, in order of precedence; AMORAIC where none matches.
CATEGORY_PERIODS = {
    "Tanakh": "BIBLICAL",
    "Torah": "BIBLICAL",
    "Prophets": "BIBLICAL",
    "Writings": "BIBLICAL",
    "Mishnah": "TANNAITIC",
    "Tosefta": "TANNAITIC",
    "Talmud": "AMORAIC",
    "Bavli": "AMORAIC",
    "Yerushalmi": "AMORAIC",
    "Midrash": "AMORAIC",
    "Halakhah": "RISHONIM",
    "Kabbalah": "RISHONIM",
    "Musar": "ACHRONIM",
    "Responsa": "ACHRONIM",
}

# Phrase pairs of structural perturbations, by family, in order of precedence.
PHRASES = {
    "obligation_to_permission": [
        ("must protect", "may protect"),
        ("has a duty to", "is allowed to"),
        ("are required to", "are permitted to"),
        ("must pay", "may pay"),
        ("shall not", "need not"),
        ("is obligated to", "is permitted to"),
        ("swore to", "considered whether to"),
        ("must tell", "may tell"),
        ("should help", "could help"),
        ("ought to", "might"),
    ],
    "add_harm": [
        ("helped", "refused to help"),
        ("protected", "endangered"),
        ("gave", "took"),
        ("saved", "abandoned"),
        ("cared for", "neglected"),
        ("forgave", "condemned"),
        ("supported", "undermined"),
        ("guided", "misled"),
        ("healed", "harmed"),
        ("blessed", "cursed"),
    ],
    "violation_to_fulfillment": [
        ("violated", "honored"),
        ("broke", "kept"),
        ("stole", "returned"),
        ("betrayed", "supported"),
        ("abandoned", "stayed with"),
        ("deceived", "was honest with"),
        ("cheated", "dealt fairly with"),
        ("destroyed", "preserved"),
        ("corrupted", "purified"),
        ("ignored", "attended to"),
    ],
}
# Role swaps, in order of precedence.
ROLE_SWAPS = [
    (r"(\w+) must (\w+) (\w+)", "$3 must $2 $1"),
    (r"(\w+) should (\w+) (\w+)", "$3 should $2 $1"),
    (r"(\w+) shall (\w+) (\w+)", "$3 shall $2 $1"),
    (r"the (\w+) must (\w+) the (\w+)", "the $3 must $2 the $1"),
    (r"(\w+) is obligated to (\w+) (\w+)", "$3 is obligated to $2 $1"),
    (r"(\w+) has a duty to (\w+) (\w+)", "$3 has a duty to $2 $1"),
]

# Characters of the positional rules for classical Chinese.
CHINESE = {
    "particles": "之者所於以為被見使令",
    "passive": "被見",
    "causative": "使令",
    "negation": "不非無未毋弗莫勿",
    "nominals": "君臣民人子父母者",
    "final": "也矣焉乎哉",
    "modals": {"必": "OBLIGATION", "須": "OBLIGATION", "當": "OBLIGATION", "應": "OBLIGATION", "宜": "OBLIGATION", "可": "LIBERTY", "得": "LIBERTY", "許": "LIBERTY", "勿": None, "莫": None, "禁": None, "不可": None},
    "predicates": {
        "殺": "HARM_PREVENTION",
        "害": "HARM_PREVENTION",
        "傷": "HARM_PREVENTION",
        "救": "CARE",
        "護": "CARE",
        "衛": "CARE",
        "愛": "CARE",
        "命": "AUTHORITY",
        "治": "AUTHORITY",
        "孝": "FAMILY",
        "悌": "FAMILY",
        "義": "FAIRNESS",
        "正": "FAIRNESS",
        "公": "FAIRNESS",
        "報": "RECIPROCITY",
        "還": "RECIPROCITY",
        "償": "RECIPROCITY",
        "仁": "CARE",
    },
}

#: A lexicon of words that the synthetic tables hold, for queries whose results shouldn't be empty.
SAMPLE_CLASSES = {"HARM": ["the", "this"], "CARE": ["of", "with"], "DUTY": ["and", "to"], "PROPERTY": ["in", "that"], "FAMILY": ["he", "you"]}
SAMPLE_LEXICON = {k: [rf"\b({'|'.join(v)})\b"] for k, v in SAMPLE_CLASSES.items()}

# Modal words with their states, in order of declaration; negations; the vowel marks that go before matching.
ARABIC_MODALS = {
    "يجب": "OBLIGATION",
    "واجب": "OBLIGATION",
    "فرض": "OBLIGATION",
    "لازم": "OBLIGATION",
    "يجوز": "LIBERTY",
    "مباح": "LIBERTY",
    "حلال": "LIBERTY",
    "حرام": "NO_RIGHT",
    "محرم": "NO_RIGHT",
    "ممنوع": "NO_RIGHT",
}
ARABIC_NEGATIONS = ["لا", "ما", "ليس", "لم", "لن", "غير"]
ARABIC_MARKS = r"[ً-ٟ]"
HEBREW_MODALS = {
    "חייב": "OBLIGATION",
    "צריך": "OBLIGATION",
    "מוכרח": "OBLIGATION",
    "מצווה": "OBLIGATION",
    "מותר": "LIBERTY",
    "רשאי": "LIBERTY",
    "יכול": "LIBERTY",
    "אסור": "NO_RIGHT",
    "אי אפשר": "NO_RIGHT",
}
HEBREW_NEGATIONS = ["לא", "אל", "בלי", "אין", "מבלי"]
HEBREW_MARKS = r"[֑-ׇ]"
# Dimensions and the names that weights are exported under; the weight of one that is missing.
WEIGHT_NAMES = {
    "HARM": "physical_harm",
    "RIGHTS": "rights_respect",
    "FAIRNESS": "fairness_equity",
    "AUTONOMY": "autonomy_respect",
    "PRIVACY": "privacy_protection",
    "SOCIETAL": "societal_environmental",
    "LEGITIMACY": "legitimacy_trust",
    "EPISTEMIC": "epistemic_quality",
}
MISSING_WEIGHT = 0.1
