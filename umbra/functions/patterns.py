"""Patterns and word lists that decide what is found. In natural order, written out."""

from __future__ import annotations

# ---- structured values, Java syntax -------------------------------------------------------------------------------
EMAIL = r"(?U)(?<![\w.+-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![\w.-])"
IPV4 = r"(?U)(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w.])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])"
SSN = r"(?U)(?<!\d)(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9})(?!\d)"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
PHONE = r"(?U)(?<![\w])(?:\+\s*\d{1,3}[\s.\-]?)?(?:\(\d{1,4}\)[\s.\-]?)?\d(?:[\s.\-]?\d){6,14}(?!\d)"
DAY_FIRST = r"(?U)(?<!\d)(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}(?!\d)"
YEAR_FIRST = r"(?U)(?<!\d)(?:19|20)\d{2}[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])(?!\d)"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
IN_WORDS = (
    rf"(?iU)(?<!\w)(?:(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\s+{MONTH}\s+(?:19|20)\d{{2}}"
    rf"|{MONTH}\s+(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}})(?!\w)"
)
BIRTH = r"(?iU)(?:\bd\.?\s*o\.?\s*b\.?\b|\bdate\s+of\s+birth\b|\bbirth\s*date\b|\bborn\b)"
BIRTH_AFTER = r"(?iU)^\s*(?:\((?:d\.?\s*o\.?\s*b\.?|date\s+of\s+birth)\)|d\.?\s*o\.?\s*b\.?)\b"
OTHER_DATE_WORDS = r"(?iU)\b(?:filing|transaction|issue|reporting|dated|date)\b"
CARD_WORDS = r"(?iU)\b(?:card|credit\s+card|debit\s+card|vis[ae]|mastercard|amex|maestro|rupay|cvv|cvc|expiry|expiration)\b"
CARD_LABELS = r"(?iU)\b(?:order|invoice|account|ticket|transaction|reference|ref|identifier|number|no|code|page|revenue|receipt|cheque|check)\b"
PHONE_WORDS = r"(?iU)\b(?:phone|mobile|telephone|tel|contact|call|fax)\b"
PHONE_LABELS = r"(?iU)\b(?:order|invoice|account|ticket|transaction|reference|ref|identifier|number|code|page|revenue)\b"
SSN_WORDS = r"(?iU)\b(?:ssn|social\s+security)\b"
#: Looser shapes for the audit of annotations.
SWEEP_EMAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SWEEP_PHONE = r"(?U)(?<![\w+])\+?\d[\d\s()+-]{6,}\d(?![\w])"

# ---- organisations, Python syntax ---------------------------------------------------------------------------------
LEGAL = (
    r"(?<![A-Za-z0-9])(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|Ltd\.?|LLP|LLC|Inc\.?|Incorporated|Corporation|Corp\.?|Co\.|P\.C\.?|PLC|GmbH|S\.A\.?|AB|N\.A\.)"
    r"(?:\s+of\s+India)?(?![A-Za-z0-9])"
)
BUSINESS = (
    r"(?<![A-Za-z0-9])(?:Technologies|Technology|Solutions|Services|Industries|Enterprises|Group|Holdings|Corporation|Company|Trust|Foundation|Association|"
    r"Associates|Partners|Partnership|Consultants|Advisors|Advisers)(?![A-Za-z0-9])"
)
ORG_WORD = r"(?:[A-Z][A-Za-z0-9&'’().-]*|\([A-Z][A-Za-z0-9&'’().-]*\)|\d+|and|of|the|for|&)"
ORG_LABEL = r"(?i)\b(?:company|issuer|registrant|promoter|undertaking|vendor|supplier|bank|name\s+of\s+company)\s*(?:name\s*)?(?:[:\-]|\bis\b)\s*(?P<value>[A-Z][A-Za-z0-9&'’.,() -]{2,100}?)(?=[,;\n]|$)"
ORG_LIST = r"(?i)\b(?:top\s+\d+\s+)?(?:customers|suppliers|vendors|service\s+providers)\s+(?:include|comprise|are)\s+"
ORG_LIST_END = r"(?i)\bNames?\s+of\s+other\b|\.\s"
ORG_CAPS_RUN = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9&'’.,/-]*(?:\s+(?:[A-Z][A-Z0-9&'’.,/-]*|AND|OF|&)){0,9}"
ORG_LEAD = (
    r"(?i)^(?:(?:our|a|an|the|formerly|registered|corporate|office|escrow|collection|bankers?|share|promoter|group|company|bank|registered|with|of|at|to|name|and|or|&|known|namely|collectively|offer)\b[\s:.-]*)+"
)
ORG_GENERIC_START = r"^(?:us\s+gaap|net\s+proceeds|financial\s+statements|board\s+and\s+shareholders|main\s+provisions|articles\s+of|memorandum\s+of|goods\s+and\s+services|promoters\s+and|stock\s+exchanges)\b"
ORG_CONTACT_WORDS = r"(?i)\b(?:email|phone|address|date|director|website|contact)\b"
ORG_HEADS = frozenset(
    "associates partners consultants advisors advisers technologies technology systems solutions services industries industry capital ventures engineering electricals electronics "
    "transformers switchgear motors products energy power steel copper corporation company holdings".split()
)
ORG_PHRASES = frozenset(
    (
        "our company", "our group", "our promoter", "our promoter selling shareholders", "promoter selling shareholders", "private limited", "india limited", "practicing company",
        "cloud services", "systemically important non banking financial company", "advisory private limited", "company", "group", "holdings",
        "registered with the registrar of companies", "the company", "the group", "offer for sale", "stock exchanges", "cloud services vendor",
        "main provisions of the articles of association", "articles of association", "memorandum of association", "financial statements of assets and liabilities of the company",
        "board and shareholders of the company", "goods and services", "promoters and promoter group", "net proceeds of the offer", "us gaap", "us gaap and ifrs",
    )
)
ORG_WORDS = frozenset(
    "a an and at bank by company conducted for formerly from group holding holdings india limited ltd name of office offer our promoter registered registrar shareholders stock the trust "
    "family with financial statements assets liabilities board promoters goods services memorandum articles provisions net proceeds gaap ifrs".split()
)
ORG_ROLES = frozenset("company secretary practicing independent professional chartered accountant accountants auditor auditors consultant advisor adviser".split())

# ---- persons ------------------------------------------------------------------------------------------------------
NAME = r"[A-Z][A-Za-z'’.-]*(?:\s+[A-Z][A-Za-z'’.-]*){1,3}"
TITLED = rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Shri|Smt)\.?\s+(?P<value>{NAME})"
LABELLED = rf"(?i)\b(?:full\s+name|name|director|promoter|chairman|signatory|contact\s+person|beneficial\s+owner|partner|executive)\s*(?:name\s*)?(?:[:\-]|\bis\b)\s*(?P<value>{NAME})"
IN_ROLE = (
    rf"(?<!\w)(?P<value>{NAME})\s*[,;:-]?\s*(?i:chief\s+executive\s+officer|chief\s+financial\s+officer|company\s+secretary|compliance\s+officer|technical\s+director|joint\s+managing\s+director|"
    r"managing\s+director|whole-time\s+director|executive\s+director|independent\s+director|non-executive\s+director|director|promoter|chairman|signatory|authori[sz]ed\s+signatory|partner|"
    r"contact\s+person|beneficial\s+owner)\b"
)
PERSON_TABLE = r"(?i)\b(?:name\s+of\s+(?:the\s+)?(?:promoter|shareholder|director|person)|contact\s+person|promoters?|promoter\s+group|designation|din|key\s+managerial\s+personnel|senior\s+management)\b"
PERSON_NEAR = r"(?i)\b(?:chairman|director|promoter|secretary|officer|auditor|engineer|management|manager|kmp|sm|person|shareholder|individual|consent|expert)\b"
#: (marker, characters looked at, whether a word of PERSON_NEAR must stand around it)
PERSON_MARKERS = (
    (r"(?i)\bcontact\s+person\b", 150, False),
    (r"(?i)\bbeing\s*,?\s*", 110, True),
    (r"(?i)\bnamely\s*,?\s*", 150, True),
    (r"(?i)\ballotted\s+to\s+", 140, False),
    (r"(?i)\bin\s+relation\s+to\s+", 100, True),
    (r"(?i)\b(?:appointed|regularized|regularised)\s+(?:as|to|in)\s+", 110, True),
    (r"(?i)\bled\s+by\s+", 280, True),
    (r"(?i)\bincluding\s*,?\s*", 280, True),
    (r"(?i)\bour\s+promoters?\s*[:,]?\s*", 280, False),
    (r"(?i)\bpromoter\s+group\s*[:,]?\s*", 280, False),
)
PERSON_STOP = r"(?i)(?:;|(?<![A-Z])\.(?=\s+[A-Z])|(?<![A-Z])\.(?=\s*$)|\b(?:telephone|email| website)\s*:)"
FROM_STOP = r"(?i)(?:,|(?<![A-Z])\.(?=\s+[A-Z]))"
FROM_NEAR = r"(?i)\b(?:consent|name|secretary|auditor|engineer)\b"
TRANSFER = r"(?i)\btransfer\s+of\s+shares?\s+(?:to|from|by)\s+"
NAME_TOKEN = r"(?<![A-Za-z0-9])(?:[A-Z]\.|[A-Z][A-Za-z'’.-]*[A-Za-z'’]|[A-Z][A-Za-z'’.-]*\.)"
TRANSFER_TOKEN = r"(?<![A-Za-z0-9])(?:[A-Z]\.|[A-Z][A-Za-z'’-]*|[A-Z]{1,3})(?![a-z])"
FIRST_NAMES = frozenset(
    "aarav aditi amaya ananya arjun ashwin bhavya charlotte daniel david deepak elena emily george harsh isabel james jane john joseph kabir kavya lucas maria maya meera michael neha noah "
    "olivia patel priya rashi ravi rohan sarah sneha sophia smith vikram yash".split()
)
HEADINGS = frozenset(
    "general information risk factors objects industry overview business management corporate governance financial statements accounting policies capital structure dividend tax regulatory "
    "disclosures material events development intellectual property plant machinery history scheme main board terms the issue offer undertaking market price distribution share shares conflict "
    "interest related transaction litigation promoters group sales profits facilities infrastructure use proceeds valuation credit rating government approvals definitions abbreviations glossary "
    "documents inspection contracts licence licenses subsidiaries report profile instruments statistics summary details contents annexure memorandum articles certificate declaration undertakings "
    "resolution resolutions benefits employees insurance litigations regulations guidelines policy standards codes rules".split()
)
NOT_IN_NAMES = frozenset(
    "technologies technology limited ltd pvt company corporation corp inc llp services solutions group holdings industries enterprises bank university school ministry government india global "
    "capital systems private public trust foundation association industrial park road street floor building apartment village taluka district state office campus website email telephone phone "
    "registration sebi icdr offer bids chartered accountants auditors statutory statutorily practicing professional engineer consultant advisor book running lead managers manager exchange london "
    "metal metropolitan region development authority kamgar sangathna land leasehold freehold assets proceeds anchor investor investors institutional non qib qibs retail individual bidders bidder "
    "shares share care report risk factors companies act supa facility manufacturing facilities other materiality policy gross insurance contributions provident funds miscellaneous provisions tax "
    "department show presentation questions strategy including details red herring prospectus eligible nris ksh infra key managerial careedge research related party transactions analytics advisory "
    "national payments stock financial statements liabilities board shareholders main articles memorandum goods bankers escrow collection net syndicate members bonus issue specified locations client "
    "id pension fund regulatory social responsibility committee csr allotment advice branch parents maharashtra pollution control family no s society marg centre center house flat plot".split()
)
DOCUMENT_WORDS = frozenset(
    "moa aoa aod sha dated date amendment addendum memorandum articles agreement deed undertaking resolution certificate consent affidavit declaration petition commission report order form schedule".split()
)
NO_NAMES = frozenset(
    "a an and are as at be being by chief compliance company contact corporate director executive for from full in including is our person promoter promoters register registered registrar selling "
    "signatory shareholder shareholders technical the to name names secretary website with or of on chairman managing joint whole-time independent non-executive beneficial owner kmp sm ceo cfo cs "
    "officer financial management personnel details offer face value equity shares date acquisition number price revenue sector generation transmission distribution industry market floor".split()
)

# ---- addresses ----------------------------------------------------------------------------------------------------
STRONG = (
    r"(?i)\b(?:house|flat|apartment|appt|residence|road|rd\.?|street|st\.?|lane|colony|nagar|marg|avenue|ave\.?|boulevard|drive|dr\.?|plot|tower|villa|village|taluka|district|gat|wing|campus|complex|"
    r"chambers|hospital|industrial\s+area|industrial\s+estate|center|centre)\b"
)
WEAK = r"(?i)\b(?:building|floor|block|sector|office|department|level|park)\b"
ADDRESS_LABEL = r"(?i)\b(?:registered\s+office|corporate\s+office|principal\s+office|office\s+address|home\s+address|mailing\s+address|address|contact\s+details?)\b\s*(?:(?:is|at)\s+|:\s*)"
ADDRESS_HINT = r"(?i)\b(?:registered\s+office|corporate\s+office|office\s+address|address|contact\s+details?)\b"
REGISTERED_AS = r"(?i)\b(?:cin|corporate\s+identity\s+number|firm\s+registration|peer\s+review|registration\s+number|reference\s+number|identifier\s+number)\b"
NO_ADDRESS = r"(?i)\b(?:national\s+automated\s+clearing\s+house|corporate\s+identity\s+number|firm\s+registration|peer\s+review\s+number)\b"
FIELD = r"(?i)\b(?:telephone|phone|mobile|e-?mail|email|website|web\s+site|contact\s+person)\s*:"
POSTAL = r"(?<![\w])\d{3}\s?\d{3}(?![\w])"
NUMBER = r"(?i)(?<!\w)(?:[A-Z]\.\s*)?(?:[A-Z]?\d{1,4}[A-Za-z]{0,3}(?:[-/]\d+)?)(?=\s|[,.;])"
NUMBERED = r"(?i)(?<!\w)(?:[A-Z]\.\s*no\.?|s\.?\s*no\.?|gat\s+no\.?|flat\s+no\.?|plot\s+no\.?|house\s+no\.?)\s*\.?\s*"
FILING = r"(?i)\b(?:form|filed|filing|incorporation|challan|application|reservation|intimation|certificate|dated|respectively|approval|license|licence|registration|commission|consent|dated)\b"
SHOW = r"(?i)\b(?:road\s+show|roadshow|presentation|schedules?)\b"
PLACED = r"(?i)\b(?:located\s+at|situated\s+at|premises\s+at|adjacent\s+to|next\s+to|at|near|opposite|off|above|behind|beside)\s+(?=[A-Z0-9])"
AT_LEAD = r"(?i)\s*(?:(?:is\s+)?(?:located|situated|found|stationed)\s+at\s+|(?:is|are|was|were)\s+at\s+|at\s+|of\s+)"
LANDMARK = r"(?i)\b(?:opposite|above|behind|near|next|adjacent|off)\b"
NAMED_BUILDING = r"([A-Z][A-Za-z0-9&'’.-]*\s+(?:Bhavan|Building|House|Centre|Center|Tower))\s*,?\s*$"
NAMED_BANK = r"(?i)^(?:the\s+)?[A-Z][A-Za-z&'’.-]*\s+bank\s*,\s*"
UNIT_BEFORE = r"(?i)\b(?:tower|flat|house|plot|gat|floor|wing|building|room|shop|basement|block|sector|no)\.?\s*$"
UNIT_AFTER = r"(?i)\s*(?:,|;)?\s*(?:tower|flat|house|plot|gat|floor|wing|building|room|shop|road|street|marg|colony|village|taluka)\b"
START_BEFORE = r"(?i)\b(?:tower|flat|house|plot|gat|floor|wing|building|room|shop|no|s\.?\s*no)\.?\s*$"
START_AFTER = r"(?i)\b(?:road|street|marg|colony|village|taluka|block)\b"
ADDRESS_END = (
    r"(?i)(?<!\bNo)(?<!\bS)(?<!\bMr)(?<!\bMrs)(?<!\bDr)(?<!\bSt)(?<!\bCo)(?<!\bInc)(?<!\bLtd)(?<!\bOpp)\.(?=\s+[A-Z])|\.(?=$)|;|\||\band\s+its\s*$|\band\s+its\s+(?:corporate|registered|principal)\s+office\b"
)
UNIT_WORDS = frozenset("apartment flat unit tower building house centre center suite shop block wing room no plot survey gst premises".split())
#: Words that are no half of a value split between two units.
NO_HALVES = frozenset(
    (
        "and", "the", "for", "its", "new", "not", "one", "our", "two", "of", "any", "all", "are", "has", "his", "her", "per", "was", "who", "will", "bank", "capital", "company", "corporate",
        "finance", "financial", "group", "holdings", "india", "industries", "international", "limited", "national", "private", "public", "services", "state", "trust", "llp", "llc", "inc", "corp",
        "pvt", "sri", "smt", "mr", "mrs", "ms", "dr", "prof", "m/s", "s/o", "w/o", "l td", "p ltd",
    )
)

# ---- replacements -------------------------------------------------------------------------------------------------
FIRST_POOL = "Aarav Maya Rohan Priya Kabir Neha Vikram Sneha Arjun Meera Rahul Ananya Yash Kavya Aditya Isha".split()
LAST_POOL = "Mehta Carter Shah Morgan Kapoor Reed Nair Bennett Joshi Rivera Malhotra Foster Iyer Brooks Desai Hayes".split()
ORG_POOL = (
    "Asteron Technologies Pvt. Ltd.", "Northstar Foods Limited", "Blue Harbor Systems Pvt. Ltd.", "Cedar Grove Solutions Limited", "Silverline Industries Pvt. Ltd.", "Maplebridge Services Limited",
)
INDIA_POOL = (
    "101 Example Avenue, New Delhi, Delhi 110001", "22 Sample Road, Pune, Maharashtra 411001", "14 Demonstration Lane, Bengaluru, Karnataka 560001", "8 Synthetic Colony, Chennai, Tamil Nadu 600001",
)
US_POOL = ("100 Example Street, Example City, NY 10001", "200 Sample Avenue, Example Town, CA 90001", "14 Placeholder Road, Exampleville, TX 75001")
US_STATE = r"\b(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY)\b"
MONTHS = "January February March April May June July August September October November December".split()
