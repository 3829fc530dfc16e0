"""Word lists, patterns and constants that must equal the reference system's for equal results."""

# Forbidden sequences in free text.
SQL_TOKENS = r"(;|--|/\*|\*/|\bxp_\b|\bexec\b|\bunion\b|\bselect\b|\bdrop\b|\binsert\b|\bupdate\b|\bdelete\b)"
PATH_TOKENS = r"(\.\./|\.\.\\|/etc/|c:\\|/var/|/root/)"

# Allowed department names.
DEPARTMENTS = [
    "Forest", "Revenue", "Finance", "Education", "Health", "Home", "Personnel", "Public Works", "Rural Development", "Urban Development",
    "ITDA", "General Administration", "Agriculture", "Transport", "Energy", "Tourism", "Social Welfare", "Irrigation", "Food & Civil Supplies", "General",
]

# Allowed policy categories.
CATEGORIES = [
    "Transfer Policy", "Pay Scale", "Regularization", "Leave Rules", "Pension & Gratuity", "Procurement", "Service Rules", "Reservation",
    "Disciplinary Action", "Promotion", "Recruitment", "General Circular", "Financial Sanction", "Budget Allocation", "Budget", "Financial Allocation",
    "Grant", "Pension",
]

# Other words for policy categories, in order.
CATEGORY_SYNONYMS = [
    ("budget", "Budget Allocation"), ("budget allocation", "Budget Allocation"), ("financial allocation", "Budget Allocation"), ("grant", "Budget Allocation"),
    ("financial sanction", "Financial Sanction"), ("sanction", "Financial Sanction"), ("transfer", "Transfer Policy"), ("posting", "Transfer Policy"),
    ("transfer policy", "Transfer Policy"), ("regularization", "Regularization"), ("samayojan", "Regularization"), ("pension", "Pension & Gratuity"),
    ("gratuity", "Pension & Gratuity"), ("pension & gratuity", "Pension & Gratuity"), ("retirement", "Pension & Gratuity"), ("leave", "Leave Rules"),
    ("leave rules", "Leave Rules"), ("holiday", "Leave Rules"), ("recruitment", "Recruitment"), ("vacancy", "Recruitment"),
]

# Department keys with their words in both languages, in order.
DEPARTMENT_WORDS = [
    ("forest", ["वन", "पर्यावरण", "forest", "wildlife", "van"]),
    ("general_admin", ["सामान्य प्रशासन", "gad", "general administration", "कार्मिक", "general"]),
    ("personnel", ["कार्मिक", "personnel", "नियुक्ति", "karmik"]),
    ("revenue", ["राजस्व", "revenue", "तहसील"]),
    ("education", ["शिक्षा", "इण्टर कालेज", "education", "विद्यालय", "shiksha"]),
    ("finance", ["वित्त", "finance", "कोषागार", "लेखा", "pension", "वेतन"]),
]

# Attempts to override instructions.
INJECTION = (
    r"(ignore\s+(all\s+)?(?:previous\s+|prior\s+|above\s+)?instructions|system\s+prompt|reveal\s+(?:internal\s+|system\s+)?prompt|"
    r"override\s+(?:safety|policy|guardrails)|developer\s+mode|jailbreak|dan\s+mode|drop\s+table|delete\s+from|bypass\s+(?:guardrails|security)|"
    r"disregard\s+(?:all\s+)?(?:previous\s+|prior\s+|above\s+)?instructions|you\s+are\s+now\s+(?:an\s+)?unconstrained)"
)

# Questions outside the scope, first match decides.
SCOPE = [
    ("financial_disbursement", r"(disburse|disbursement|treasury|arreas|arrears|bhej\s+do|calculate\s+(?:pension|salary|gratuity|payout)|pension\s+calculation|salary\s+calculation|खाते\s*में\s*(?:डाल|भेज)|कोषागार\s*में\s*भेज|भुगतान\s*कर|disburse\s+karo)"),
    ("grievance", r"(register\s+(?:my\s+|a\s+|the\s+)?(?:complaint|grievance|shikayat)|complaint\s+(?:register|karo|darj|lodged?)|complaint|grievance|shikayat|शिकायत\s*(?:दर्ज|कर)|action\s*lo|कार्रवाई\s*करो|सड़क\s*खराब|रास्ता\s*खराब|pani\s+nahi\s+aa\s+raha)"),
    ("order_drafting", r"(draft\s+(?:a\s+)?(?:new\s+)?(?:executive\s+|administrative\s+|government\s+|state\s+)*(?:order|go|policy|circular|notification)|draft\s+(?:an?\s+)?(?:order|go|policy|circular|notification)|नया\s*आदेश\s*(?:बना|तैयार\s*कर|ड्राफ्ट)|शासनादेश\s*ड्राफ्ट|draft\s+karo)"),
    ("policy_opinion", r"(kya\s+(?:.*)\s+(?:achhi|buri|theek|sahi)\s+hai|personal\s+opinion|your\s+opinion|opinion|critique|अच्छी\s*है\s*या\s*बुरी|राय\s*(?:दीजिये|दो)|समीक्षा\s*करो|is\s+(?:the\s+)?(?:new\s+)?(?:state\s+)?(?:policy|scheme|order)\s+(?:good|bad|beneficial|detrimental)|beneficial\s+or\s+detrimental|is\s+policy\s+(?:good|bad))"),
]

# Departments and policies named in a question, first match decides.
QUERY_DEPARTMENTS = [
    ("Forest", r"वन\s*(?:विभाग|अनुभाग|संरक्षण)?|forest"), ("Finance", r"वित्त\s*(?:विभाग|अनुभाग|स्वीकृति)?|finance|budget|बजट"),
    ("Personnel", r"कार्मिक\s*(?:विभाग|अनुभाग)?|personnel|तबादला|स्थानांतरण|transfer"), ("Revenue", r"राजस्व\s*(?:विभाग|अनुभाग)?|revenue"),
    ("Education", r"शिक्षा\s*(?:विभाग|अनुभाग)?|education|teacher|शिक्षक"), ("Rural Development", r"ग्राम्य\s*विकास|rural\s*development"),
    ("Urban Development", r"नगर\s*विकास|urban\s*development"), ("Home", r"गृह\s*(?:विभाग|अनुभाग)?|police|home|पुलिस"),
    ("Health", r"चिकित्सा|स्वास्थ्य|health|medical"),
]
QUERY_POLICIES = [
    ("Transfer Policy", r"transfer|posting|तबादला|स्थानांतरण"), ("Regularization", r"regularization|samayojan|नियमितीकरण|समायोजन"),
    ("Budget Allocation", r"budget|grant|अनुदान|वित्तीय\s*स्वीकृति|राशि|लाख|allocated|किश्त|आयोग"), ("Recruitment", r"recruitment|vacancy|भर्ती|नियुक्ति|पद"),
    ("Pension", r"pension|retirement|पेंशन|सेवानिवृत्ति"), ("Leave Rules", r"leave|holiday|अवकाश|छुट्टी"),
]
ORDER_IN_QUERY = r"(?:शासनादेश\s*(?:संख्या|संo|सं०)?|GO\s*(?:number|no\.?)?|संख्या|संo|सं०)\s*[:\-]?\s*([0-9A-Za-z\/\-\_\(\)\.]+)"
ORDER_STOP_WORDS = (
    "kya hai ka ke ki ko par se aur number no batao bhejo chahiye dekho karo please mein konsa kaunsa bataiye rules policy detail details kya_hai kon kaun".split()
)
HINGLISH = "mein kya hai ke baare bhejo ka ki ko par se aur tha hogi".split()

# Scale words and their factors, in order; the first word contained decides.
SCALES = [
    ("करोड़", 10000000), ("करोड", 10000000), ("cr", 10000000), ("crore", 10000000), ("crores", 10000000), ("लाख", 100000), ("lakh", 100000),
    ("lacs", 100000), ("हजार", 1000), ("हज़ार", 1000), ("thousand", 1000), ("k", 1000),
]
# Without the words that may stand before a scale ("Rs. in"): they decide nothing.
HEADER_SCALES = [("करोड़|करोड|crores?|cr", 10000000, "करोड़"), ("लाख|lakhs?|lacs?", 100000, "लाख"), ("हजार|हज़ार|thousands?|k", 1000, "हज़ार")]
# Of each scale in that order: what every spelling holds in lower case. No "s", which a pattern without regard to case finds in "ſ" too.
HEADER_SCALE_PARTS = [["करो", "cr"], ["लाख", "lakh", "lac"], ["हज", "thou", "k"]]
TOTAL_WORDS = ["योग", "कुल", "कुल योग", "महायोग", "total", "grand total", "sum"]
SANCTIONED = ["स्वीकृत", "आवंटन", "sanctioned", "allotted", "provision"]
SPENT = ["व्यय", "expenditure", "spent"]
BALANCE = ["अवशेष", "balance", "remaining", "बचत"]
# Digits that scans confuse, with penalties. Letters that look like digits are left out: only the digits of a
# cell are read, so they never occur.
CONFUSIONS = [
    ("3", "8", 1.0), ("3", "9", 1.5), ("3", "2", 2.0), ("8", "3", 1.0), ("8", "0", 1.2), ("8", "9", 1.5), ("1", "7", 1.0), ("1", "4", 1.8),
    ("7", "1", 1.0), ("7", "9", 1.8), ("0", "8", 1.2), ("0", "6", 1.8), ("5", "6", 1.5), ("5", "9", 1.8), ("6", "5", 1.5), ("6", "0", 1.8),
    ("6", "8", 1.8), ("9", "3", 1.5), ("9", "8", 1.5), ("9", "7", 1.8), ("9", "4", 2.0), ("2", "3", 1.8), ("2", "7", 2.0), ("4", "1", 1.8), ("4", "9", 2.0),
]

# Names of months in order of their test, digits of the script.
MONTHS = [
    ("जनवरी", 1), ("फरवरी", 2), ("फरबरी", 2), ("मार्च", 3), ("अप्रैल", 4), ("अप्रेल", 4), ("मई", 5), ("जून", 6), ("जुलाई", 7), ("अगस्त", 8),
    ("सितम्बर", 9), ("सितंबर", 9), ("अक्टूबर", 10), ("अक्तूबर", 10), ("नवम्बर", 11), ("नवंबर", 11), ("दिसम्बर", 12), ("दिसंबर", 12),
]
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
DATE_WITH_NAME = r"(?:दिनांक|दनिांक|Dated|Date)\s*[:\-]?\s*(\d{1,2})\s+([^\d\s,]+)[,\s]+(\d{4})"
DATE_IN_DIGITS = r"(\d{1,2}[\/\.\-]\d{1,2}[\/\.\-]\d{4})"

# Remarks that are no claims, markers of preambles and of JSON.
NEGATIVE_REMARKS = ["उल्लेख नहीं", "प्रावधान नहीं", "उपलब्ध नहीं", "अभिलेखों में नहीं", "विवरण नहीं", "स्पष्ट नहीं"]
JSON_KEYS = r"\"(?:go_number|issuing_department|exact_text_excerpt|page_number|date|citations|bounding_box)\"\s*:"
ANSWER_KEYS = ["answer_markdown", "answermarkdown", "answer", "response", "content", "markdown", "text"]

# Keywords that tie a citation to a passage.
CITATION_WORDS = ["रवन्ना", "transit", "वैधता", "15 दिन", "रॉयल्टी", "royalty", "खण्ड (9)", "खण्ड (10)", "clause 9", "clause 10", "150 ग्राम", "2000"]

# Canonical departments by pattern, first match decides.
CANONICAL_DEPARTMENTS = [
    ("सामान्य प्रशासन विभाग", r"सामान्य\s*प्रशासन|general\s*administration"), ("वित्त विभाग", r"वित्त\s*(?:विभाग|अनुभाग)|finance|वित्त\s*आयोग"),
    ("वन विभाग", r"वन\s*(?:विभाग|अनुभाग|संरक्षक)|forest"), ("कार्मिक विभाग", r"(?:कार्मिक|कर्मिक)\s*(?:विभाग|अनुभाग|अलुम्गा)|personnel|vigilance"),
    ("राजस्व विभाग", r"राजस्व\s*(?:विभाग|अनुभाग)|revenue"), ("शिक्षा विभाग", r"शिक्षा\s*(?:विभाग|अनुभाग)|education"),
    ("ग्राम्य विकास विभाग", r"ग्राम्य\s*विकास|rural\s*development"), ("नगर विकास विभाग", r"नगर\s*विकास|urban\s*development"),
    ("गृह विभाग", r"गृह\s*(?:विभाग|अनुभाग)|police|home"), ("चिकित्सा स्वास्थ्य विभाग", r"चिकित्सा|स्वास्थ्य|health"),
]
SECTION_NAMES = r"((?:कार्मिक|सामान्य\s*प्रशासन|वन|वित्त|राजस्व|शिक्षा|गृह|चिकित्सा|न्याय|परिवहन|ऊर्जा|ग्राम्य\s*विकास|नगर\s*विकास)\s*(?:विभाग|अनुभाग)[^\n,:]*)"
DRAFT_NUMBER = r"संख्या\s*[—\-]?\s*[\n\r]*\s*/|संख्या\s*[—\-]?\s*[\s_]{2,}/|[\s_]{2,}/|संख्या\s*[—\-]?\s*$"

# Fragments that corrupted text layers hold.
MOJIBAKE = [
    "oe qff", "gibo", "siion", "5reuqdr", "g{ifrt{", "qth egti", "ih?pl", "ebi", "ell", "pnbie", "bibe", "eb btn", "ahie", "wio", "bggnou",
    "bn blihif", "wlain", "pherial", "pif0 yu", "fosajeemieom", "b8+:b2z435", "l-lei", "plit er", "lei plit",
]
