"""Fixed values of the relation model: vocabularies, templates and constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

RELATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("entity1", "entity2", "entity1Type", "entity2Type", "relation")]
)
RELATIONS = T.ArrayType(RELATION)

# The relation types of the published ontology.
CANONICAL_RELATIONS = (
    "parent_father_of", "parent_mother_of", "child_of", "sibling_of", "spouse_of", "relative_of", "adopted_by",
    "companion_of", "friend_of", "lover_of", "rival_of", "enemy_of", "inspires", "sacrifices_for", "mentor_of",
    "teacher_of", "protector_of", "employer_of", "leader_of", "member_of", "lives_in", "lived_in", "visits", "travel_to",
    "born_in", "travels_by", "participates_in", "causes", "owns", "believes_in", "embodies", "located_in", "part_of",
    "owned_by", "occupied_by", "used_by", "affects", "experienced_by", "travels_in", "based_in", "attended_by", "ends_in",
    "occurs_in", "features", "stored_in", "expressed_by", "associated_with",
)

# Relations whose stored direction carries no meaning.
SYMMETRIC_RELATIONS = (
    "companion_of", "friend_of", "enemy_of", "rival_of", "sibling_of", "spouse_of", "relative_of",
)

# What stands between the two names in a relation's sentence.
PREDICATES = {
    "parent_father_of": "is the father of", "parent_mother_of": "is the mother of", "child_of": "is a child of",
    "sibling_of": "is a sibling of", "spouse_of": "is a spouse of", "relative_of": "is a relative of",
    "adopted_by": "was adopted by", "companion_of": "is a companion of", "friend_of": "is a friend of",
    "lover_of": "is a lover of", "rival_of": "is a rival of", "enemy_of": "is an enemy of",
    "mentor_of": "is a mentor of", "teacher_of": "is a teacher of", "protector_of": "is a protector of",
    "employer_of": "is an employer of", "leader_of": "is a leader of", "member_of": "is a member of",
    "travel_to": "travels to", "born_in": "was born in", "located_in": "is located in", "part_of": "is part of",
    "owned_by": "is owned by", "occupied_by": "is occupied by", "used_by": "is used by",
    "experienced_by": "is experienced by", "based_in": "is based in", "attended_by": "was attended by",
    "stored_in": "is stored in", "expressed_by": "is expressed by", "associated_with": "is associated with",
}

# Last tokens that mark a name as pronoun or generic noun.
PRONOUN_GENERIC = (
    "he", "she", "her", "his", "him", "you", "your", "yours", "me", "my", "mine", "i", "we", "our", "ours", "us", "they",
    "them", "their", "theirs", "it", "its", "mother", "father", "son", "daughter", "husband", "wife", "brother", "sister",
    "child", "baby", "parent", "mamma", "mama", "mom", "papa", "dad", "daddy",
)
IRREGULAR_FORMS = ("children", "sonne", "sonnes")
ARCHAIC_FORMS = ("thee", "thou", "thy", "thine", "ye", "hath", "doth")

# Words that a nameable entity does not start with, and roles that name nobody.
LEADING_FUNCTION_WORDS = (
    "he", "she", "her", "his", "him", "you", "your", "my", "me", "i", "we", "our", "us", "they", "them", "their", "it",
    "its", "the", "a", "an", "this", "that", "these", "those", "some", "little", "young", "old",
)
SOCIAL_ROLES = ("party", "people", "man", "woman", "boy", "girl", "lady", "gentlewoman")

# Titles that do not identify anybody, and suffixes that tell two people apart.
HONORIFICS = (
    "mr", "mr.", "mrs", "mrs.", "miss", "ms", "ms.", "dr", "dr.", "sir", "lady", "lord", "madam", "madame", "messer",
    "signior", "signor", "king", "queen", "prince", "princess", "count", "countess", "duke", "duchess", "the", "a", "an",
    "justice", "judge", "doctor", "captain", "reverend", "rev", "rev.",
)
DISTINGUISHING_SUFFIXES = (
    "jr", "jr.", "junior", "sr", "sr.", "senior", "ii", "iii", "iv", "elder", "younger", "young", "old",
)

# Verbs and nouns that mention a relation besides the noun of its predicate.
VERB_FORMS = {
    "mentor_of": "mentor", "lover_of": "love", "teacher_of": "teach", "protector_of": "protect", "employer_of": "employ",
    "leader_of": "lead",
}
NOUN_SYNONYMS = {
    "spouse_of": ("husband", "wife"), "child_of": ("son", "daughter"), "sibling_of": ("brother", "sister"),
    "parent_mother_of": ("son", "daughter"), "parent_father_of": ("son", "daughter"),
}

# The noun by which a question names a relation; relations without one are named by no noun.
RELATION_NOUNS = {
    "parent_father_of": "father", "parent_mother_of": "mother", "child_of": "child", "sibling_of": "sibling", "spouse_of": "spouse",
    "relative_of": "relative", "adopted_by": "adopted", "companion_of": "companion", "friend_of": "friend", "lover_of": "lover",
    "rival_of": "rival", "enemy_of": "enemy", "mentor_of": "mentor", "teacher_of": "teacher", "protector_of": "protector",
    "employer_of": "employer", "leader_of": "leader", "member_of": "member", "born_in": "born", "located_in": "located", "part_of": "part",
    "owned_by": "owned", "occupied_by": "occupied", "used_by": "used", "experienced_by": "experienced", "based_in": "based",
    "attended_by": "attended", "stored_in": "stored", "expressed_by": "expressed", "associated_with": "associated",
}

# Patterns by which a question mentions a noun, after an article and before "of", or after a possessor.
NOUN_OF = r"\b{article}\s+(?:\w+\s+){{0,2}}{noun}\s+of\b"
OWNED_NOUN = r"\b\w+'s\s+(?:\w+\s+){{0,2}}{noun}(?:'s\b|[?,]|$)"
AFTER_OWNER = r"(?:\s+\w+){{0,2}}'s\s+(?:\w+\s+){{0,2}}(?:{nouns})(?:'s\b|[?,]|$)"

# First words that make a name look generic, and articles that do so before a name without capitals.
PRONOUN_LIKE = ("he", "she", "it", "they", "him", "her", "them", "his", "hers", "their", "himself", "herself", "itself", "themselves")
ARTICLE_LIKE = ("the", "his", "her", "their", "a", "an")

# Patterns of titles and particles in names.
TITLE_PATTERN = r"(?i)^(sir|king|queen|lord|lady|prince|princess|dr\.?|mr\.?|mrs\.?|miss)\s+"
PARTICLE_PATTERN = r"(?i)\b(van|von|de|di|du|der|le|la)\s+"

# First words and whole names that the earlier predicate of nameable entities rules out, as they are written.
OLD_FUNCTION_WORDS = (
    "he", "she", "her", "his", "him", "you", "your", "my", "me", "i", "we", "our", "us", "they", "them", "their", "it", "its", "the", "a",
    "an", "this", "that", "these", "those", "some", "little", "young", "old",
)
OLD_GENERIC = (
    "husband", "wife", "son", "daughter", "brother", "sister", "party", "people", "man", "woman", "boy", "girl", "baby", "lady",
)

# Relations that look like events.
EVENT_RELATIONS = (
    "killed_by", "kills", "married_to", "marries", "attacked_by", "attacks", "captured_by", "captures", "rescued_by", "rescues", "died",
    "born", "fought", "wounded_by", "wounds",
)

# Fixed values: (relation, slot of the stored triple that the noun names, noun that phrases questions).
ROLE_STEPS = (
    ("parent_father_of", "e1", "father"), ("parent_father_of", "e2", "son"), ("parent_mother_of", "e1", "mother"),
    ("parent_mother_of", "e2", "son"), ("child_of", "e1", "child"), ("spouse_of", "sym", "spouse"),
    ("sibling_of", "sym", "sibling"), ("companion_of", "sym", "companion"), ("friend_of", "sym", "friend"),
    ("enemy_of", "sym", "enemy"), ("rival_of", "sym", "rival"), ("relative_of", "sym", "relative"),
    ("employer_of", "e1", "employer"), ("leader_of", "e1", "leader"), ("mentor_of", "e1", "mentor"),
    ("teacher_of", "e1", "teacher"), ("protector_of", "e1", "protector"),
)

# Words of relative position in a text.
ANCHORS = {
    "beginning": 0.0, "start": 0.0, "outset": 0.0, "opening": 0.0, "middle": 0.5, "midpoint": 0.5, "halfway point": 0.5,
    "half way point": 0.5, "halfway through": 0.5, "half way through": 0.5, "halfway": 0.5, "end": 1.0, "close": 1.0,
    "conclusion": 1.0, "finale": 1.0,
}
ORDINALS = {
    "first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4, "sixth": 5, "seventh": 6, "eighth": 7, "ninth": 8,
    "tenth": 9, "last": -1,
}
FRACTIONS = {
    "half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fourth": 4, "fourths": 4, "fifth": 5,
    "fifths": 5, "tenth": 10, "tenths": 10,
}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
# Patterns of phrases of relative position, with the vocabularies above as alternatives.
THROUGH_PATTERN = r"\b(?:({numbers})|a)[\s-]({fractions})\s+(?:of\s+the\s+way\s+)?through\b"
PART_PATTERN = r"\b(?:the\s+)?({ordinals})\s+({fractions})\b(?:\s+of\s+the\s+(?:book|story|narrative))?"
EDGE_PATTERN = r"\b(early|late)\s+(?:in|on)\s+the\s+(?:book|story|narrative)\b"
ANCHOR_PATTERN = r"\b(near|around|about|close to|towards?|by|right at|exactly at)?\s*(?:the\s+)?({anchors})\b"
NEAR_WINDOW, EXACT_WINDOW, EDGE_WINDOW = 0.10, 0.03, 0.15

# Stop words that betray a language, in the order of preference.
LANGUAGE_MARKERS = {
    "french": ("le", "la", "les", "des", "une", "un", "et", "de", "du", "dans", "que", "pour", "avec", "est", "elle", "il"),
    "german": ("der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine"),
    "spanish": ("el", "la", "los", "las", "que", "para", "con", "una"),
}

MIN_BINS, MAX_BINS, FACTS_PER_BIN = 6, 20, 15
MAX_PATHS = 20
