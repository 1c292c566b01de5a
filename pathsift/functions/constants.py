"""Fixed values that must equal the reference's for equal results.

Everything in this module is a constant of the original application (tag
lists, labels, sentinels, cut-offs) or a published list (Spark's English stop
words).  Kept together and in natural order on purpose.
"""

# --- fixed values: structural HTML elements used to enumerate candidate paths
STRUCTURAL_TAGS = ["body", "header", "nav", "footer", "article", "section", "aside", "div", "span"]

# --- fixed values: DOM-summary element sets chosen by the page's doctype
HTML5_SUMMARY_TAGS = ["header", "nav", "footer", "article", "section", "aside", "div", "span"]
HTML4_SUMMARY_TAGS = ["div", "span"]

# --- fixed values: child elements skipped when reading a node's text
SKIP_CHILD_TAGS = ["script"]

# --- fixed values: sentinel stored when a path has no node or no text
EMPTY = "empty"

# --- fixed values: extract type written with every extract row
XPATH_TYPE = "Attribs"

# --- fixed values: entity labels kept from token taggers and span taggers
TOKEN_ENTITY_TAGS = ["PERSON", "ORGANIZATION"]
SPAN_ENTITY_LABELS = ["PERSON", "ORG", "WORK_OF_ART", "PRODUCT"]

# --- fixed values: entity placeholder written by the cleanup job
NO_ENTITIES = "No NERs Recognized"

# --- fixed values: application constants
TRAIN_DOC_LIMIT = 50        # train while a domain has fewer processed documents
RESULT_LIMIT = 50           # rows returned by topic and entity searches
LDA_TOPICS = 20
LDA_PASSES = 100
TOP_TERMS_APP = 20          # keywords shown per topic
TOP_TERMS_REPORT = 100      # terms per topic in the reports
SIMILAR_TOPICS = 5
POLL_SECONDS = 600

# --- fixed values: Spark ML's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english"), 181 words, in its order)
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't "
    "didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()
