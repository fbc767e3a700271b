"""Word lists, bands and patterns that results depend on."""

# fixed values: sentiment
POSITIVE = "good great happy love enjoy excited optimistic positive amazing fantastic wonderful proud satisfied confident hopeful".split()
NEGATIVE = "bad sad hate angry upset worried anxious negative terrible awful depressed lonely frustrated guilty ashamed".split()

# fixed values: relation classes
TAXONOMIC = "is_a type_of kind_of class_of form_of".split()
CAUSAL = "causes leads_to results_in affects influences".split()

# fixed values: words that exclude a persona, by category
EXCLUDE = {
    "primary": "teacher professor lecturer instructor parent mother father mom dad doctoral phd postdoc".split(),
    "secondary": ["professor", "lecturer", "postdoc", "phd", "kindergarten teacher", "preschool teacher"],
    "highschool": ["professor", "lecturer", "postdoc", "phd", "kindergarten teacher", "preschool teacher"],
    "university": ["high school teacher", "middle school teacher", "elementary teacher", "primary teacher", "principal", "headmaster"],
}
HIGH_SCHOOL_ROLES = [
    "high school student", "high schooler", "high school senior", "high school junior", "high school sophomore",
    "high school freshman", "upper secondary student",
]

# fixed values: ages
AGE_PATTERN = r"(?i)([0-9]{1,2})\s*-*\s*(?:years?\s*-?\s*old|y/o|yrs?)"
PHRASE_AGES = [
    ("child", 5), ("young child", 4), ("younger child", 4), ("kid", 6), ("little kid", 5), ("younger sibling", 6), ("young student", 7),
    ("schoolchild", 8), ("school child", 8), ("pupil", 8), ("schoolboy", 8), ("schoolgirl", 8), ("primary school student", 8),
    ("elementary school student", 9), ("middle school student", 13), ("junior high student", 13), ("high school student", 16),
    ("high-school student", 16), ("college student", 19), ("university student", 19), ("student council president", 17),
    ("student council", 17), ("debate team captain", 18), ("debate team", 17), ("varsity", 17), ("cheerleader", 16),
]
SCHOOL_AGES = [
    (("preschool",), 3), (("kindergarten",), 5), (("primary school", "elementary school"), 8),
    (("middle school", "junior high", "secondary school"), 13), (("high school", "highschool"), 16), (("university", "college"), 19),
]
AGE_GROUPS = {"young_child": 5, "primary_school_child": 9, "middle_school_student": 13, "high_school_student": 16, "university_student": 19}
#: Conditions of the age cascade, in order: every phrase of one of the groups must occur.
AGE_CASCADE = [
    ([("preschool",)], 3), ([("kindergarten",)], 5), ([("primary school",)], 8), ([("elementary",)], 8), ([("middle school",)], 12),
    ([("high school",)], 16), ([("university", "student")], 19),
    ([("first grade",), ("1st grade",)], 6), ([("second grade",), ("2nd grade",)], 7), ([("third grade",), ("3rd grade",)], 8),
    ([("fourth grade",), ("4th grade",)], 9), ([("fifth grade",), ("5th grade",)], 10), ([("sixth grade",), ("6th grade",)], 11),
    ([("seventh grade",), ("7th grade",)], 12), ([("eighth grade",), ("8th grade",)], 13),
    ([("9th grade",), ("ninth grade",), ("high school freshman",)], 14), ([("sophomore", "high")], 15), ([("junior", "high")], 16), ([("senior", "high")], 17),
    ([("freshman", "university"), ("freshman", "college")], 18),
    ([("first year", "college"), ("first year", "undergraduate"), ("first year", "undergrad")], 18), ([("senior", "university")], 22),
]
AGE_REGIMES = [("primary_school", 5, 10), ("secondary_school", 11, 14), ("high_school", 15, 18), ("university_freshman", 17, 18)]
REGIME_AGES = [("primary", 3, 11), ("secondary", 11, 14), ("highschool", 14, 18), ("university", None, 18)]
AGE_BINS = [(4, 5), (6, 7), (8, 9), (10, 11), (12, 13), (15, 16), (17, 18)]
#: Readability bands, in order: (from or None, below or up to, grade).
DRP_BANDS = [(None, 44, "Grades K–1"), (42, 54, "Grades 2–3"), (52, 60, "Grades 4–5"), (57, 67, "Grades 6–8"), (62, 72, "Grades 9–10"), (67, 74, "Grades 11–12")]

DRP_BEYOND = "College and Career Readiness (CCR)"

# fixed values: model names that are rewritten, and regimes that file names carry
MODEL_NAMES = [("gemma3", "gemma-3"), ("phi4", "phi-4"), ("llama3.3", "Llama-3.3"), ("qwen3", "Qwen3")]
KNOWN_REGIMES = ["primary", "secondary", "highschool", "high_school", "university"]

# fixed values: ages of grades, of roles and of school levels, in order, for the third age rule
GRADE_AGES = {1: 6, 2: 7, 3: 8, 4: 9, 5: 10, 6: 11, 7: 12, 8: 13, 9: 14, 10: 15, 11: 16, 12: 17}
ROLE_AGES = [
    ("preschool", 3), ("kindergarten", 5), ("middle school student", 12), ("middle schooler", 12), ("high school freshman", 14),
    ("high school sophomore", 15), ("high school junior", 16), ("high school senior", 17), ("college freshman", 18), ("university freshman", 18),
    ("first-year college student", 18), ("first year university student", 18),
]
LEVEL_AGES = [
    (("primary school", "elementary school"), 8), (("secondary school", "middle school"), 12), (("high school",), 16), (("university", "college"), 18),
]

# fixed values: why a persona is none of its category: ages (below, reason, above, reason), then (reason, phrases)
STRICT_AGES = {
    "primary": (3, "age too young (infant)", 11, "age too old for primary"),
    "secondary": (11, "age too young for secondary", 14, "age too old for secondary"),
    "university": (15, "age too young for university", 18, "age exceeds maximum allowed for university regime"),
}
STRICT_PHRASES = {
    "primary": [
        ("fictional character", ["fictional character", "storybook character", "children's storybook", "fairy tale"]),
        ("retrospective framing", ["from the 80s", "in the 80s", "when i was a child", "back then", "used to be"]),
        ("not the persona themselves", ["my child", "their child", "his child", "her child", "someone else's child", "parent of", "attend with their toddler"]),
    ],
    "secondary": [
        ("primary school mention", ["elementary school", "primary school", "kindergarten", "preschool", "grade school"]),
        ("high school mention", ["high school", "upper secondary", "college prep", "sat", "act"]),
        ("retrospective framing", ["when i was in middle school", "back in middle school", "used to be in middle school", "former middle school student"]),
        ("not the persona themselves", ["my child", "their child", "his child", "her child", "parent of"]),
        ("fictional character", ["fictional character", "storybook character", "novel character"]),
    ],
    "university": [
        ("non-freshman undergraduate", ["sophomore", "junior", "senior", "upperclassman", "second year", "third year", "final year"]),
        ("graduate-level student", ["graduate student", "postgraduate", "master's", "phd", "doctoral", "mba"]),
        ("retrospective framing", ["alumni", "former student", "when i was in college", "back in college", "after graduating college"]),
        ("not the persona themselves", ["older sibling", "younger sibling", "parent of", "advisor to", "shares tips with", "offers advice to"]),
        ("fictional character", ["fictional character", "novel character", "story character"]),
    ],
}
SCHOOL_OF_INFANTS = ["preschool", "kindergarten", "nursery", "early education"]
FRESHMAN_SIGNS = ["freshman", "first year", "first-year", "incoming", "just started university", "starting university"]
ENROLLED_SIGNS = ["studying at", "enrolled at", "attends", "current college", "university student"]

# fixed values: phrases of a text that is not a pupil's
NO_PUPIL = [
    "teacher", "professor", "principal", "headmaster", "educator", "counselor", "faculty", "chaperone", "director", "coordinator", "mother", "father",
    "parent", "guardian", "mom ", "dad ", "veteran", "elderly", "husband", "wife", "grown-up", "millennial", "entrepreneur", "plumber", "doctor",
    "civil engineer", "professional", "reunion", "prom night 19", "in the 90s", "years ago", "looking back", "memories of", "fondly remembers",
    "stumbled upon", "university student", "college student", "undergraduate", "old friend", "best friend", "friend from", "friend of",
    "recent graduate", "graduate from", "graduated", "dropped out", "dropout", "played", "used to play", "was a", "discovered", "started in",
    "began in", "remembers", "remember", "memories", "good old days", "commentator", "football coach", "head coach", "assistant coach", "moved out",
    "relocated", "living in", "awaiting", "applying to", "middle school", "junior high", "primary school", "kindergarten", "alumn", "didn't finish",
    "old classmate",
]
WILL_GRADUATE = ["will graduate", "to graduate", "soon graduate", "hopes to"]
COMIC_SERIES = ["slice of life", "girls und panzer"]

# fixed values: tokens that model output leaks, and relations that deny
CONTROL_TOKENS = ["|eot_id|", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "assistant", "user", "system"]
NEGATION_WORDS = ["not", "no", "never", "neither", "nor", "without"]
NEGATION_PHRASES = [
    "not related", "no connection", "not available", "not applicable", "not connected", "no relation", "no link", "not involved",
    "not associated", "without connection", "without relation", "unconnected", "unrelated", "disconnected", "disassociated",
    "nonapplicable", "nonexistent", "unavailable", "uninvolved",
]
LABEL_PREFIXES = [
    "nsubj:", "dobj:", "pobj:", "prep:", "amod:", "advmod:", "ROOT:", "VERB:", "NOUN:", "ADJ:", "dep:", "compound:", "agent:", "xcomp:", "ccomp:",
    "aux:", "auxpass:",
]
ADJECTIVE_ENDS = "ed ing al ive ous ful ic ish y".split()
NOUN_ENDS = "tion ity ness ence ance dom hood ship th".split()

# fixed values: metrics of trimming, capping, tests and log scales
TRIMMED = ["num_triplets", "num_unique_concepts", "triplets_per_100_tokens", "graph_num_nodes", "graph_num_edges"]
CAPPED = ["graph_density", "graph_avg_degree"]
TESTED = ["num_triplets", "num_unique_concepts", "graph_density", "triplets_per_100_tokens", "graph_avg_degree"]
LOGGED = ["num_triplets", "num_unique_concepts", "graph_num_nodes", "graph_num_edges", "triplets_per_100_tokens"]
TRIM_QUANTILES = (0.05, 0.95)
IQR_FACTOR = 1.5
MIN_CONFIDENCE = 80
