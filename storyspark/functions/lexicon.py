"""Word lists and tables that results depend on."""

# Parts of speech of closed classes and common words.
DETERMINERS = "the a an this these those my your his her its our their some any no every each all both few many much most other".split()
PREPOSITIONS = (
    "in on at to for with by from of about into through during before after above below between under over against among around behind beside beyond near toward towards upon "
    "within without across along inside outside throughout"
).split()
AUXILIARIES = "is are was were be been being am have has had having do does did doing".split()
MODALS = "can could will would shall should may might must".split()
CONJUNCTIONS = "and or but nor yet so because although while if unless until since when where whether".split()
PRONOUN_WORDS = "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves".split()
RELATIVES = "who whom whose which that".split()
ADJECTIVES = (
    "old new good bad great small large big little young long short high low early late first last ancient dark bright powerful mighty wise evil grey black white red blue green "
    "golden silver"
).split()
ADVERBS = "very quite rather really too just only now then here there always never often sometimes slowly quickly suddenly finally already still even".split()
VERBS_IN_TEXT = "go went gone come came say said see saw know knew take took get got make made walk run ran live speak spoke fight fought kill love hate rule serve attack".split()
NOUNS = ["king", "ring"]
#: The letter that stands for each part in a sequence of tags; P is a proper noun, U punctuation.
PARTS_OF_SPEECH = [
    ("D", DETERMINERS),
    ("I", PREPOSITIONS),
    ("X", AUXILIARIES),
    ("M", MODALS),
    ("C", CONJUNCTIONS),
    ("R", PRONOUN_WORDS),
    ("L", RELATIVES),
    ("J", ADJECTIVES),
    ("A", ADVERBS),
    ("V", VERBS_IN_TEXT),
    ("N", NOUNS),
]
#: Suffixes that decide where no list does, in this order; the rest are nouns.
SUFFIXES = (("A", ("ly",)), ("V", ("ing", "ed", "en")), ("N", ("ness", "tion", "ment", "ity", "er", "or")), ("J", ("ful", "less", "ous", "ive", "able", "ible")))

# Words left out of names, kinds by priority, endings that a verb loses.
NAME_STOP_WORDS = "mr mrs ms dr prof the of and a an to in on for at by is it as be was are been with from into that this has have had his her its their".split()
KIND_PRIORITY = {"CHARACTER": 10, "PLACE": 8, "FACTION": 7, "ORGANIZATION": 7, "ITEM": 5, "CONCEPT": 3, "OTHER": 2, "EVENT": 1}
VERB_ENDINGS = ("ing", "ed", "es", "s", "er", "tion", "ness")

# A verb's stem, its event, its relation, and what it takes.
VERBS = [
    ("accus", "ACCUSATION", "ACCUSES", "transitive"),
    ("admir", "MEET", "LOVES", "transitive"),
    ("alli", "MEET", "INTERACTS", "intransitive"),
    ("approach", "TRAVEL", "ARRIVES", "intransitive"),
    ("are", "STATE", "IS", "transitive"),
    ("arriv", "TRAVEL", "ARRIVES", "intransitive"),
    ("ask", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("attack", "BATTLE", "ATTACKS", "transitive"),
    ("bargain", "BARGAIN", "INTERACTS", "intransitive"),
    ("battl", "BATTLE", "FIGHTS", "intransitive"),
    ("be", "STATE", "IS", "transitive"),
    ("becam", "TRANSFORM", "BECOMES", "transitive"),
    ("became", "TRANSFORM", "BECOMES", "transitive"),
    ("become", "TRANSFORM", "BECOMES", "transitive"),
    ("been", "STATE", "IS", "transitive"),
    ("betray", "BETRAYAL", "BETRAYS", "transitive"),
    ("build", "CREATE", "CREATES", "transitive"),
    ("call", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("caus", "CAUSE", "CAUSES", "transitive"),
    ("claim", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("command", "DIALOGUE", "RULES", "transitive"),
    ("conceal", "CONCEALS", "CONCEALS", "transitive"),
    ("creat", "CREATE", "CREATES", "transitive"),
    ("crie", "DIALOGUE", "SPEAKS_TO", "intransitive"),
    ("deceiv", "DECEIVES", "DECEIVES", "transitive"),
    ("declar", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("defeat", "BATTLE", "DEFEATS", "transitive"),
    ("depart", "TRAVEL", "DEPARTS", "intransitive"),
    ("destroy", "DEATH", "DESTROYS", "transitive"),
    ("discov", "DISCOVERY", "DISCOVERS", "transitive"),
    ("duel", "DUEL", "FIGHTS", "intransitive"),
    ("enabl", "CAUSE", "ENABLES", "transitive"),
    ("encount", "MEET", "INTERACTS", "transitive"),
    ("enter", "TRAVEL", "ARRIVES", "transitive"),
    ("exit", "TRAVEL", "DEPARTS", "transitive"),
    ("explain", "DIALOGUE", "SPEAKS_TO", "ditransitive"),
    ("fear", "BATTLE", "HATES", "transitive"),
    ("fight", "BATTLE", "FIGHTS", "transitive"),
    ("find", "DISCOVERY", "FINDS", "transitive"),
    ("follow", "MEET", "SERVES", "transitive"),
    ("fought", "BATTLE", "FIGHTS", "transitive"),
    ("friend", "MEET", "INTERACTS", "transitive"),
    ("give", "ACQUIRE", "GIVES", "ditransitive"),
    ("hat", "BATTLE", "HATES", "transitive"),
    ("hear", "DISCOVERY", "OBSERVES", "transitive"),
    ("heard", "DISCOVERY", "OBSERVES", "transitive"),
    ("help", "RESCUE", "SAVES", "transitive"),
    ("hid", "CONCEALS", "CONCEALS", "transitive"),
    ("is", "STATE", "IS", "transitive"),
    ("join", "MEET", "INTERACTS", "transitive"),
    ("journey", "TRAVEL", "TRAVELS", "intransitive"),
    ("kill", "DEATH", "KILLS", "transitive"),
    ("learn", "DISCOVERY", "DISCOVERS", "transitive"),
    ("leav", "TRAVEL", "DEPARTS", "transitive"),
    ("li", "DECEIVES", "DECEIVES", "intransitive"),
    ("look", "DISCOVERY", "OBSERVES", "transitive"),
    ("lov", "MEET", "LOVES", "transitive"),
    ("make", "CREATE", "CREATES", "transitive"),
    ("meet", "MEET", "INTERACTS", "transitive"),
    ("mention", "DIALOGUE", "MENTIONS", "transitive"),
    ("notic", "DISCOVERY", "OBSERVES", "transitive"),
    ("observ", "DISCOVERY", "OBSERVES", "transitive"),
    ("own", "ACQUIRE", "OWNS", "transitive"),
    ("prevent", "PREVENT", "PREVENTS", "transitive"),
    ("promis", "PROMISE", "PROMISES", "ditransitive"),
    ("repli", "DIALOGUE", "SPEAKS_TO", "intransitive"),
    ("rescu", "RESCUE", "SAVES", "transitive"),
    ("reveal", "REVEALS", "REVEALS", "transitive"),
    ("rul", "TRIAL", "RULES", "transitive"),
    ("said", "DIALOGUE", "SPEAKS_TO", "ditransitive"),
    ("sail", "TRAVEL", "TRAVELS", "intransitive"),
    ("sav", "RESCUE", "SAVES", "transitive"),
    ("saw", "DISCOVERY", "OBSERVES", "transitive"),
    ("say", "DIALOGUE", "SPEAKS_TO", "ditransitive"),
    ("see", "DISCOVERY", "OBSERVES", "transitive"),
    ("serv", "MEET", "SERVES", "transitive"),
    ("shout", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("slay", "DEATH", "KILLS", "transitive"),
    ("speak", "DIALOGUE", "SPEAKS_TO", "intransitive"),
    ("spoke", "DIALOGUE", "SPEAKS_TO", "intransitive"),
    ("state", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("steal", "THEFT", "STEALS", "transitive"),
    ("suggest", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("support", "MEET", "ALLIES", "transitive"),
    ("take", "ACQUIRE", "TAKES", "transitive"),
    ("tell", "DIALOGUE", "SPEAKS_TO", "ditransitive"),
    ("threaten", "THREAT", "THREATENS", "transitive"),
    ("told", "DIALOGUE", "SPEAKS_TO", "ditransitive"),
    ("transform", "TRANSFORM", "BECOMES", "transitive"),
    ("travel", "TRAVEL", "TRAVELS", "intransitive"),
    ("trust", "MEET", "ALLIES", "transitive"),
    ("turn", "TRANSFORM", "BECOMES", "intransitive"),
    ("uncover", "DISCOVERY", "DISCOVERS", "transitive"),
    ("visit", "TRAVEL", "ARRIVES", "transitive"),
    ("was", "STATE", "IS", "transitive"),
    ("watch", "DISCOVERY", "OBSERVES", "transitive"),
    ("were", "STATE", "IS", "transitive"),
    ("whisper", "DIALOGUE", "SPEAKS_TO", "transitive"),
    ("witness", "DISCOVERY", "OBSERVES", "transitive"),
    ("wound", "BATTLE", "ATTACKS", "transitive"),
    ("yell", "DIALOGUE", "SPEAKS_TO", "intransitive"),
]

# What a kind's event says of its object's kind, and the pronouns by gender.
INFERRED = {
    "CHARACTER": {
        "BATTLE DUEL DEATH MEET NEGOTIATE BETRAYAL RESCUE MARRIAGE PROMISE THREAT ACCUSATION": "CHARACTER",
        "TRAVEL": "PLACE",
        "ACQUIRE LOSE THEFT CREATE": "ITEM",
    },
    "FACTION": {"BATTLE NEGOTIATE": "FACTION"},
    "ORGANIZATION": {"BATTLE NEGOTIATE": "FACTION"},
}
PRONOUNS = {"male": "he him his", "female": "she her hers", "neutral": "it its", "plural": "they them their"}
