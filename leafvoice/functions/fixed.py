"""Word lists, patterns and constants the results depend on."""

# --- fixed values: ligatures that decode to a blank, in order of preference
LIGATURES = ["fi", "fl", "ff", "ffi", "ffl"]

# --- fixed values: words that a dropped ligature may have broken
LIGATURE_WORDS = """
confidence confident confidential scientific scientist first
find finds finding findings fine finger fingers finish
finished firm firmly fight fighting field fields figure
figures file files fill filled film final finally
financial fifty fifteen fifth fix fixed definite
definitely definition define defined benefit benefits
significant significantly significance confirm confirmed
identify identified identification specific specifically
difficult difficulty difficulties sufficient sufficiently
efficient efficiency office officer officers official
artificial certificate classification classified justification
justified magnificent modification modified notification
pacific profit profits qualified satisfied satisfying
terrific unified verified verify amplified beautified
clarify clarified gratifying horrified identifies notify
prefix profile profiles refine refined selfish superficial
testify unfit fiction fifty figurative filter finance
fiscal fitness fitting firsthand firefighter
flat flag flame flash flat flavor flesh flight
flights float floating flood floor floors flow flowing
flower flowers fluid fly flying reflect reflected
reflection reflex influence influenced conflict conflicts
inflation inflict overflow reflects fluent fluctuate
effort efforts effect effects effective effectively
efficacy offer offers offered offering different
difference differences differently differ suffer suffered
suffering buffer coffee affair affairs affect affected
afford office offices staff stuff traffic affirm
affirmation diffuse sniff stiff cliff off
difficulties sufficiency shuffle shuffled baffle baffled
""".split()

# --- fixed values: short words that are never extended by a ligature
NEVER_EXTEND = """
a an as at be by do go he if in is it
me my no of on or so to up us we am and
the for are but not you all any can had her
was one our out day get has him his how its
new now old see two way who did may say she
too use own end far few let put run set ten
top try why yes yet ill off over life like
""".split()

# --- fixed values: words that follow a hyphen which is real punctuation
HYPHEN_FOLLOWERS = ["or", "and", "nor", "but", "to", "through", "versus", "vs"]

# --- fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "jr", "sr", "st", "prof", "rev", "hon",
    "e.g", "i.e", "etc", "cf", "vs", "no", "vol", "pp", "fig", "ch",
    "u.s", "u.k", "u.n", "ph.d", "m.d", "b.a", "m.a", "d.c",
]

# --- fixed values: headings recognised by wording alone
NUMBERED_HEADING = r"(?i)^(chapter|section|part)\s+([ivxlcdm]+|\d+)"
NAMED_HEADING = r"(?i)^(prologue|epilogue|preface|introduction|foreword|afterword|conclusion)\b"

# --- fixed values: titles that open a book, and titles that never do
CONTENT_START = r"(?i)^(introduction|prologue|preface|foreword|chapter\s+\w+|part\s+\w+|one\b)"
FRONT_MATTER = (
    r"(?i)^(title\s*page|copyright|dedication|contents|table\s+of\s+contents|also\s+by|praise\s+for"
    r"|epigraph|about\s+the\s+author|index|notes|acknowledg|bibliograph|colophon|imprint)"
)

# --- fixed values: voice names in order of preference
VOICE_PATTERNS = [
    "(?i)siri", "(?i)premium", "(?i)enhanced", "(?i)neural",
    "(?i)^Google (US|UK) English", "(?i)Samantha", "(?i)Daniel",
]

# --- fixed values: text that cannot be spoken
CODE_FENCE = r"```[\s\S]*?```"
LATEX_BLOCK = r"\\\[[^\]]{1,500}\\\]|\\\(.+?\\\)|\\begin\{[^}]+\}[\s\S]*?\\end\{[^}]+\}"
LATEX_INLINE = r"\$[^$\n]{1,200}\$"
BOX_DRAWING = "[│┃┄┈─━┆┇┊┋╌╍═║]+"
SOFT_HYPHEN = "\u00ad"

# --- fixed values: characters by their part in the Unicode sentence rules, as ranges of code points in hexadecimal
SENTENCE_ENDS = (
    "21 3F 589 61D-61F 6D4 700-702 7F9 837 839 83D-83E 964-965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809 "
    "1944-1945 1AA8-1AAB 1B5A-1B5B 1B5E-1B5F 1B7D-1B7E 1C3B-1C3C 1C7E-1C7F 203C-203D 2047-2049 2E2E 2E3C 2E53-2E54 3002 A4FF "
    "A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE56-FE57 FF01 FF1F FF61 10A56-10A57 "
    "10F55-10F59 10F86-10F89 11047-11048 110BE-110C1 11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 "
    "1144B-1144C 115C2-115C3 115C9-115D7 11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C 11C41-11C42 11EF7-11EF8 "
    "11F43-11F44 16A6E-16A6F 16AF5 16B37-16B38 16B44 16E98 1BC9F 1DA88"
)
FULL_STOPS = "2E 2024 FE52 FF0E"
SENTENCE_CONTINUES = (
    "2C-2D 3A-3B 37E 55D 60C-60D 7F8 1802 1808 2013-2014 3001 FE10-FE11 FE13-FE14 FE31-FE32 FE50-FE51 FE54-FE55 FE58 FE63 "
    "FF0C-FF0D FF1A-FF1B FF64"
)

# --- fixed values: numbers
CHARS_PER_SEC = 14            # speaking rate at rate 1.0
MIN_SENTENCE_SEC = 0.4
MAX_SENTENCE_CHARS = 350
MAX_DRIFT_CHARS = 90          # interpolation limit past the last boundary
SCANNED_CHARS_PER_PAGE = 50
SCANNED_MIN_PAGES = 3
LINE_TOLERANCE = 1.5
SPACE_EM = 0.2
GLYPH_EM = 0.5
LINE_HEIGHT_EM = 1.4
DEFAULT_LINE_HEIGHT = 14.0
PARAGRAPH_GAP = 1.6
SIZE_CHANGE_MIN = 1.0
SIZE_CHANGE_SHARE = 0.08
CHROME_MIN_PAGES = 4
CHROME_MAX_CHARS = 80
CHROME_SHARE = 0.4
HEADING_SCALE = 1.25
HEADING_MAX_CHARS = 100
HEADING_MAX_WORDS = 14
TITLE_MAX_CHARS = 200
MIN_SECTIONS = 3
PART_WORDS = 3000
MIN_CONTENT_SENTENCES = 5
DEBOUNCE_MS = 3000
STALL_SEEN_MS = 2500
STALL_UNSEEN_MS = 1500
