"""The vocabulary by which postings and people are classified."""

# functions in the order in which they are tried, each with the substrings that tell it
FUNCTION_KEYWORDS = (
    ("engineering", ("engineer", "engineering", "developer", "swe", "sre", "devops", "infrastructure", "backend", "frontend", "full stack", "fullstack", "software")),
    ("product", ("product manager", "product owner", "product lead", "growth pm")),
    ("design", ("designer", "design ", " design", "ux", "ui")),
    ("data", ("data scientist", "data engineer", "data analyst", "machine learning", "ml engineer", "analytics")),
    ("sales", ("sales", "account executive", "account manager", "business development", "bdr", "sdr")),
    ("marketing", ("marketing", "growth", "content", "brand", "seo")),
    ("customer_success", ("customer success", "customer support", "support engineer", "csm")),
    ("operations", ("operations", " ops", "chief of staff", "program manager")),
    ("finance", ("finance", "accounting", "controller", "fp&a")),
    ("people", ("people ", "recruiter", "recruiting", "talent", "human resources", " hr ")),
    ("legal", ("legal", "counsel", "compliance")),
)
# levels in the order in which they are tried
SENIORITY_KEYWORDS = (
    ("founding", ("founding",)),
    ("executive", ("chief ", "ceo", "cto", "coo", "cfo", "cpo", "cro", "cmo", "founder")),
    ("vp", ("vp ", "vice president")),
    ("director", ("director",)),
    ("manager", ("manager", "head of")),
    ("principal", ("principal", "lead ")),
    ("staff", ("staff",)),
    ("senior", ("senior",)),
    ("entry", ("junior", "entry", "associate")),
    ("intern", ("intern",)),
)
SENIORITY_RANK = {"intern": 0, "entry": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 5, "lead": 6, "manager": 7, "director": 8, "vp": 9, "executive": 10, "founding": 3}
# score of a lead's rank over the job's: none above 3 or below 0
SENIORITY_BASE = {0: 0.3, 1: 1.0, 2: 0.9, 3: 0.6}
ADJACENT_FUNCTIONS = (("data", "engineering"), ("design", "product"))
# size of the company: upper bound, founder bonus, multiplier of the seniority penalty
TIERS = ((20, 0.35, 0.3), (50, 0.20, 0.6), (150, 0.05, 1.0), (None, -0.10, 1.0))
# where the size is unknown: funding stage to the tier's place
STAGE_TIER = {"pre-seed": 0, "seed": 0, "series a": 1, "series b": 2}
WEIGHTS = {"function": 0.35, "seniority": 0.30, "ownership": 0.20, "location": 0.05, "recruiter": 0.15, "short_tenure": -0.10}
REPORTS_TO = r"(?i)reports?\s+to\s+(?:the\s+)?([A-Z][A-Za-z/&\- ]{2,60})"
# what each weakness takes from a match's confidence
CONFIDENCE_LOSS = {"unclassified": 0.15, "degraded": 0.20, "guessed": 0.10, "thin": 0.15, "unreachable": 0.15}
# labels of a score, best first, with the least score of each
LABELS = (("correct_owner", 0.6), ("plausible", 0.3))
OWNER_TITLES = {
    "engineering": ("VP Engineering", "Head of Engineering", "Director of Engineering", "Engineering Manager", "CTO"),
    "product": ("VP Product", "Head of Product", "Director of Product", "Group Product Manager", "CPO"),
    "design": ("Head of Design", "Design Director", "Design Manager"),
    "data": ("Head of Data", "Director of Data", "Data Science Manager", "Head of ML"),
    "sales": ("VP Sales", "Head of Sales", "Sales Director", "CRO", "Head of Revenue"),
    "marketing": ("VP Marketing", "Head of Marketing", "CMO", "Head of Growth"),
    "customer_success": ("VP Customer Success", "Head of Customer Success", "Head of Support"),
    "operations": ("COO", "Head of Operations", "Director of Operations", "Chief of Staff"),
    "finance": ("CFO", "VP Finance", "Head of Finance", "Controller"),
    "people": ("Head of People", "VP People", "CHRO", "Head of Talent"),
    "legal": ("General Counsel", "Head of Legal"),
}
FOUNDER_TITLES = ("CEO", "Founder", "Co-Founder", "CTO", "COO")
RECRUITING_TITLES = ("Technical Recruiter", "Recruiter", "Talent Acquisition", "Head of Talent", "Talent Partner", "Recruiting Coordinator")
# board hosts by platform
HOSTS = (
    ("greenhouse", "boards.greenhouse.io"), ("greenhouse", "job-boards.greenhouse.io"), ("lever", "jobs.lever.co"), ("ashby", "jobs.ashbyhq.com"), ("workable", "apply.workable.com"),
    ("smartrecruiters", "careers.smartrecruiters.com"), ("recruitee", "recruitee.com"), ("rippling", "ats.rippling.com"), ("personio", "jobs.personio.de"), ("personio", "jobs.personio.com"),
)
EMBEDS = (("greenhouse", "boards.greenhouse.io/embed/job_board"), ("lever", "cdn.lever.co"), ("ashby", "embed.ashbyhq.com"))
TOKENS = {
    "greenhouse": r"(?i)(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?([\w-]+)",
    "lever": r"(?i)jobs\.lever\.co/([\w-]+)",
    "ashby": r"(?i)(?:jobs|embed)\.ashbyhq\.com/([\w-]+)",
    "workable": r"(?i)apply\.workable\.com/(?!j/)([\w-]+)",
    "smartrecruiters": r"(?i)careers\.smartrecruiters\.com/([\w-]+)",
    "recruitee": r"(?i)([\w-]+)\.recruitee\.com",
    "rippling": r"(?i)ats\.rippling\.com/([\w-]+)",
}
JOB_LINK = r"(?i)/(?:jobs?|careers?|positions?|openings?)/[\w-]{3,}"
ASSET_LINK = r"(?i)\.(?:svg|png|jpe?g|gif|ico|css|js|mjs|woff2?|ttf|eot|webp|avif|json|map)(?:[?#]|$)"
LINK_TEXT, LINK_HREF = r"(?i)careers?|jobs|join us|we'?re hiring|work with us|open roles", r"(?i)careers?|jobs|join|hiring|opportunities"
BLOG_HREF, AGGREGATOR_TEXT = r"(?i)/blog/|/news/|/press/", r"(?i)other companies|browse (all )?jobs|job board for"
# how like a careers link an anchor is: text, address, known board, in the page's frame, a blog, an aggregator
ANCHOR_POINTS = {"text": 5, "href": 4, "board": 5, "chrome": 2, "blog": -3, "aggregator": -5}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b")
PLACE_CLASS, PLACE_TEXT, PLACE_LENGTH = r"(?i)locat|city|office|region", r"(?i)\b(?:remote|hybrid|on-?site)\b|,\s*[A-Za-z]{2,}(?:\s|$)|\b(?:USA|US|UK|EU)\b", 120
# marks of a platform in a page: "#" an id, "." a class, "[]" an attribute; "*" a part of it
DOM_MARKS = (("greenhouse", "#", "grnhse_app"), ("lever", ".", "lever-job"), ("lever", ".*", "lever-jobs"), ("ashby", "[]", "data-ashby-embed"), ("ashby", "#*", "ashby"))
CAREERS_COPY, JOB_DETAIL = r"(?i)open positions|join our team|current openings", r"(?i)/jobs?/[\w-]+"
CAREERS_PATHS = ("/careers", "/career", "/jobs", "/join", "/join-us", "/hiring", "/work-with-us", "/about/careers", "/company/careers", "/en/careers")
EMPLOYMENT_TYPES = {
    "FULL_TIME": "full_time", "FULLTIME": "full_time", "FULL-TIME": "full_time", "FULL TIME": "full_time", "PART_TIME": "part_time", "PARTTIME": "part_time", "PART-TIME": "part_time", "PART TIME": "part_time",
    "CONTRACT": "contract", "CONTRACTOR": "contract", "TEMPORARY": "contract", "INTERN": "internship", "INTERNSHIP": "internship",
}
WORKPLACE_TYPES = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite", "on_site": "onsite", "on site": "onsite", "office": "onsite", "in-office": "onsite"}
# ranking: half-life in days and least weight of a posting's age, weights of how a lead can be reached, shares of signals of the company
RECENCY_HALF_LIFE, RECENCY_LEAST = 14.0, 0.3
REACH = (("verified email", 1.0), ("guessed email", 0.7), ("phone only", 0.6), ("no contact on file", 0.4))
CONTEXT = {"funding": 0.15, "hiring": 0.10}
FUNDING_WORDS = ("raised", "funding", "series a", "series b", "seed round", "investment")
HIRING_WORDS = ("hiring", "growth", "expanding", "new head", "joins as", "appoints")
# words that say nothing when texts are compared; those of titles beside
STOP_WORDS, GENERIC_TITLE_WORDS = ("of", "the", "and", "a", "an"), ("vp", "head", "chief", "director", "manager", "lead", "president", "officer", "of")
# employment types as two platforms and all others write them
LEVER_TYPES = {"full time": "full_time", "part time": "part_time", "contract": "contract", "temporary": "contract", "internship": "internship", "intern": "internship"}
ASHBY_TYPES = {"fulltime": "full_time", "parttime": "part_time", "contract": "contract", "intern": "internship", "internship": "internship"}
SCHEMA_TYPES = {"FULL_TIME": "full_time", "PART_TIME": "part_time", "CONTRACTOR": "contract", "TEMPORARY": "contract", "INTERN": "internship"}
# confidence of each way to tell a page's platform, and the least one that routes to it
FINGERPRINTS = {"url_host": 0.98, "redirect": 0.95, "embed": 0.90, "network": 0.85, "dom": 0.75, "cname": 0.60}
ROUTABLE, ROUTING_LEAST = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "rippling"), 0.8
SPA_ROOTS, SUSPENSE_MARK = ("root", "app", "__next", "___gatsby"), "<!--$-->"
# confidence of each way to find a company's careers page
RESOLUTION = {"manual": 1.0, "homepage_board": 0.95, "homepage_own": 0.85, "path": 0.75, "sitemap": 0.75, "search_restricted": 0.60, "search_open": 0.40}
UNRESOLVED = ("no_careers_page", "resolution_unvalidated", "domain_unreachable", "needs_review")
