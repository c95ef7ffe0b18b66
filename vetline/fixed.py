"""Fixed values.

FIXED VALUES: the entries below must equal the values the screening
workflow uses for its decisions (keyword list, language and level names,
board columns, markers, thresholds).  They are stated plainly, in their
natural order, and are data, not logic.
"""

# --- intake ---------------------------------------------------------------
# Job-id pattern inside e-mail HTML and the canonical posting URL built from it.
JOB_ID_PATTERN = r"linkedin\.com(?:/comm)?/jobs/view/(\d+)"
CANONICAL_URL_PREFIX = "https://www.linkedin.com/jobs/view/"
CANONICAL_URL_SUFFIX = "/"
DEFAULT_SOURCE = "LinkedIn"
EMAIL_PLACEHOLDER_MARK = "- Email -"

# Default exclusion keywords (case-insensitive substring of the listing name),
# in list order; the first hit is the reported one.
DEFAULT_EXCLUSION_KEYWORDS = [
    "pwc", "praktikum", "assistant", "interim", "vollzeit", "ewor", "kpmg",
    "accenture", "steuerberater", "finanz", "tankstations", "student",
    "graduate", "internship", "vaeridion", "associate", "fractional",
    "mercor", "accounting", "mandarin",
]

# Characters not allowed in a listing name.
INVALID_NAME_CHARS = '<>:"/\\|?*'

# --- page text --------------------------------------------------------------
CLOSED_MARKER = "no longer accepting applications"
ALERT_CUT_MARKER = "Set alert for similar jobs"
RULE_SEPARATORS = ["\n* * *\n", "\n---\n", "\n- - -\n"]
STRIP_HEADINGS = ["use ai to assess how you fit", "people you can reach out to"]
NO_RESULTS_MARKERS = ["No matching jobs", "no matching jobs"]
RESULTS_END_SENTINEL = "Are these results helpful"
DESCRIPTION_MIN_HTML = 200          # a description block must exceed this
FALLBACK_BLOCK_MAX_TEXT = 20000     # fallback block text must stay under this
FALLBACK_BLOCK_MAX_CHILDREN = 30
TITLE_ANCHOR_MIN_TEXT = 10
TITLE_ANCHOR_MAX_CLIMB = 6
TITLE_CUT = 60
COMPANY_CUT = 40

# --- extraction response ----------------------------------------------------
ACCEPTED_LANGS = ["en", "pt", "es"]

LANG_EXEMPT = [
    "english", "en", "inglês", "ingles", "inglés", "anglais", "englisch",
    "portuguese", "pt", "português", "portugues", "portugués", "portugiesisch",
    "spanish", "es", "espanhol", "español", "espanol", "espagnol", "spanisch",
    "german", "de", "deutsch", "alemão", "alemao", "alemán", "aleman", "allemand",
]
LEVELS_B2_PLUS = [
    "b2", "c1", "c2", "fluent", "native", "mother tongue",
    "full professional", "full professional proficiency",
    "professional proficiency", "advanced", "upper intermediate",
    "business fluent", "near native", "bilingual",
]
LEVELS_B1_EXTRA = [
    "b1", "intermediate", "lower intermediate", "conversational",
    "working proficiency", "limited working proficiency",
    "professional", "business",
]
LANG_FRENCH = ["french", "fr", "français", "francais", "french language",
               "francês", "frances", "francés", "französisch", "franzosisch"]
LANG_DUTCH = ["dutch", "nl", "flemish", "vlaams", "nederlands", "dutch language",
              "flemish dutch", "holandês", "holandes", "holandés", "neerlandais",
              "néerlandais", "niederländisch"]

REMOTE_SYNONYMS = ["REMOTE", "RMTE", "FULLY REMOTE", "REMOTE WORK", "WORLDWIDE"]
CITY_CODE4_REMOTE, CITY_CODE4_EMPTY = "RMTE", "UNKN"
CITY_CODE7_REMOTE, CITY_CODE7_EMPTY = "REMOTE", "UNKNOWN"

# --- scoring ----------------------------------------------------------------
SCORE_START = 100
AUTO_REJECT_SCORE_THRESHOLD = 30
ONCE_ONLY_CRITERION = "industr"
ONCE_ONLY_NOTE = " [duplicate — industry bonus applied once only]"
LOCATION_FLAG = "location disqualifier"
ROLE_FLAG = "role disqualifier"
LOW_SCORE_REASON = "Role"
EXTRACT_ATTEMPTS = 2
SCORE_ATTEMPTS = 3
CHARS_PER_TOKEN = 4

# --- listing table and board ------------------------------------------------
LISTING_COLUMNS = [
    "ref_nr", "fit_score", "date_published", "city", "tag",
    "job_title", "company_name", "source", "date_found", "status",
    "report_produced", "processed", "url",
    "date_considered", "date_priorities", "date_in_process",
    "date_applied", "date_rejected", "comment",
    "reject_reason",
]
LEGACY_COLUMN_COUNT = 13

# Board column -> stored status, in folder order (later folder wins at sync).
BOARD_COLUMNS = ["new", "rejects", "consider", "priorities", "in_process", "applied"]
STATUS_FOR_COLUMN = {
    "new": "new",
    "rejects": "rejected",
    "consider": "in_consideration",
    "priorities": "priorities",
    "in_process": "in_process",
    "applied": "applied",
}
DATE_COLUMN_FOR = {
    "consider": "date_considered",
    "priorities": "date_priorities",
    "in_process": "date_in_process",
    "applied": "date_applied",
    "rejects": "date_rejected",
}
ACTIVE_COLUMNS = ["new", "consider", "priorities", "in_process"]
REJECT_REASONS = ["Location", "Seniority", "Stack", "Company", "Pay", "Role",
                  "Expired", "Language(s)"]
EXPIRY_DAYS = 30
EXPIRED_REASON = "Expired"
