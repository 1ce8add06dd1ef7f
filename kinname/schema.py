"""The record table, the search modes and the fixed values of approximate name search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("first_name", T.StringType(), False),
    T.StructField("last_name", T.StringType(), False),
    T.StructField("middle_name", T.StringType()),
    T.StructField("date_of_birth", T.DateType(), False),
    T.StructField("nicknames", T.ArrayType(T.StringType(), False), False),
    T.StructField("person_id", T.StringType(), False),
])

#: Rows of a result page, and rows of it that trigram neighbours may claim.
RESULT_LIMIT, TRIGRAM_SLOTS = 200, 80
#: Least similarity of a trigram match, and most edits of an edit-distance match.
LEAST_SIMILARITY, MOST_EDITS = 0.3, 2
MAX_NAME_LENGTH = 50

#: The bit of each mode in match_source. 8 is free and marks edit distance within plans.
BITS = {"prefix": 1, "legacy": 2, "soundex": 4, "dm": 16, "trigram": 32}
EDITS_BIT = 8


@dataclass(frozen=True)
class Mode:
    label: str
    description: str
    default: bool = False


#: The names and labels of the modes.
MODES = {
    "prefix": Mode("Exact prefix", "Names that start so, in any case.", True),
    "soundex": Mode("Soundex", "Names of the same Soundex code."),
    "levenshtein": Mode("Levenshtein", "Edit distance of 2 at most, on top of other modes or alone."),
    "dm": Mode("Daitch-Mokotoff", "Names that share a Daitch-Mokotoff code."),
    "trigram": Mode("Trigram", "Nearest by character trigrams, from a similarity of 0.3 on."),
    "legacy": Mode("LIKE (unindexed)", "Names that hold the text anywhere."),
}
DEFAULT_MODES = [k for k, m in MODES.items() if m.default]
SORTS = {"dob_asc": "date_of_birth", "dob_desc": "-date_of_birth"}

#: Canonical first names and their nicknames.
NICKNAMES = {
    "DANIEL": ["DAN", "DANNY"], "MICHAEL": ["MIKE", "MICKEY"], "ROBERT": ["BOB", "BOBBY", "ROB"], "WILLIAM": ["BILL", "BILLY", "WILL"],
    "JAMES": ["JIM", "JIMMY"], "RICHARD": ["RICK", "RICKY", "DICK"], "THOMAS": ["TOM", "TOMMY"], "CHRISTOPHER": ["CHRIS"],
    "ANTHONY": ["TONY"], "MATTHEW": ["MATT"], "JOSEPH": ["JOE", "JOEY"], "DAVID": ["DAVE"], "ANDREW": ["ANDY"], "JOSHUA": ["JOSH"],
    "NICHOLAS": ["NICK"], "JONATHAN": ["JON"], "BENJAMIN": ["BEN"], "CHARLES": ["CHARLIE", "CHUCK"], "ALEXANDER": ["ALEX"],
    "STEPHEN": ["STEVE"], "KENNETH": ["KEN", "KENNY"], "DOUGLAS": ["DOUG"], "GREGORY": ["GREG"], "TIMOTHY": ["TIM", "TIMMY"],
    "RONALD": ["RON", "RONNIE"], "SAMUEL": ["SAM"],
    "ELIZABETH": ["LIZ", "BETH", "BETTY"], "JENNIFER": ["JEN", "JENNY"], "PATRICIA": ["PAT", "PATTY"], "MARGARET": ["MAGGIE", "PEG"],
    "SUSAN": ["SUE", "SUSIE"], "SANDRA": ["SANDY"], "KIMBERLY": ["KIM"], "DEBORAH": ["DEB", "DEBBIE"], "ANGELA": ["ANGIE"],
    "CYNTHIA": ["CINDY"], "CATHERINE": ["CATHY", "KATE"], "SAMANTHA": ["SAM"], "VICTORIA": ["VICKY"], "CHRISTINA": ["CHRIS"],
    "JUDITH": ["JUDY"], "KATHRYN": ["KATHY", "KATE"], "JACQUELINE": ["JACKIE"], "TERESA": ["TERRY"], "SARAH": ["SARA"],
}
