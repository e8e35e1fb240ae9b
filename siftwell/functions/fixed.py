"""Word lists, patterns, thresholds and wording that results depend on."""

# Keywords of each industry; the first in order wins a tie.
INDUSTRIES = {
    "Software": ["software", "saas", "platform", "cloud", "api", "app", "application", "tech", "technology"],
    "Consulting": ["consulting", "advisory", "services", "strategy", "business", "management"],
    "E-commerce": ["ecommerce", "retail", "shop", "store", "marketplace", "buy", "sell"],
    "Finance": ["finance", "banking", "investment", "fintech", "payment", "financial", "money"],
    "Healthcare": ["health", "medical", "clinic", "hospital", "care", "pharma", "healthcare"],
    "Marketing": ["marketing", "advertising", "media", "social", "campaign", "brand"],
    "Education": ["education", "learning", "school", "university", "course", "training", "edu"],
    "Real Estate": ["real estate", "property", "realestate", "estate", "housing", "rent", "buy"],
    "Travel": ["travel", "tourism", "hotel", "booking", "vacation", "flight", "airline"],
    "Food & Beverage": ["restaurant", "food", "beverage", "cafe", "catering", "delivery"],
}

# Size bands: words (tested in this order), upper bounds of counts, and revenue.
SIZE_WORDS = {
    "1-10": ["startup", "early stage", "small team", "small business"],
    "11-50": ["growing", "medium sized", "expanding", "scale up"],
    "51-200": ["established", "mid sized", "corporate", "professional"],
    "201-500": ["large", "enterprise", "major", "substantial"],
    "500+": ["huge", "massive", "very large", "major corporation"],
}
SIZE_BOUNDS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500")]
SIZE_ABOVE = "500+"
SIZE_PATTERNS = [r"(\d+)\s+employees?", r"team\s+of\s+(\d+)", r"(\d+)\s+person\s+team", r"(\d+)\s+staff"]
REVENUE = {"1-10": "$0-1M", "11-50": "$1M-10M", "51-200": "$10M-50M", "201-500": "$50M-100M", "500+": "$100M+"}

# Patterns of contacts, titles and founding years, in the order in which they are tried.
CONTACT_PATTERNS = [
    r"(?:CEO|Founder|President|CTO|CFO|COO|Director|Manager|Lead)\s+([A-Z][a-z]+\s[A-Z][a-z]+)",
    r"(?:Founder|Owner|Director|Manager|Lead)\s+([A-Z][a-z]+\s[A-Z][a-z]+)",
    r"(?:CEO|CTO|CFO|COO)\s+([A-Z][a-z]+\s[A-Z][a-z]+)",
    r"([A-Z][a-z]+\s[A-Z][a-z]+)\s+(?:CEO|Founder|President|CTO|CFO|COO|Director|Manager|Lead)",
]
TITLE_PATTERNS = [r"(?i)(CEO|Founder|President|CTO|CFO|COO|Director|Manager|Lead|VP|President|Owner)", r"(?i)(Chief\s+\w+\s+Officer)"]
YEAR_PATTERNS = [
    r"(?i)(?:founded|established|started|launched|incorporated)\s+in?\s+(19\d{2}|20\d{2}|'\d{2})",
    r"(?i)(?:founded|established|started|launched|incorporated)\s+(19\d{2}|20\d{2}|'\d{2})",
    r"(?i)(19\d{2}|20\d{2})\s+(?:founded|established|started|launched|incorporated)",
    r"(?i)(?:since|from)\s+(19\d{2}|20\d{2})",
]
# Words of which a text must have one (lower-cased but for contacts) for each of these patterns to be found in it.
PATTERN_WORDS = {
    "digits": [["employee"], ["team"], ["person"], ["staff"]],
    "contact_name": [
        ["CEO", "Founder", "President", "CTO", "CFO", "COO", "Director", "Manager", "Lead"],
        ["Founder", "Owner", "Director", "Manager", "Lead"],
        ["CEO", "CTO", "CFO", "COO"],
        ["CEO", "Founder", "President", "CTO", "CFO", "COO", "Director", "Manager", "Lead"],
    ],
    "contact_title": [["ceo", "founder", "president", "cto", "cfo", "coo", "director", "manager", "lead", "vp", "owner"], ["officer"]],
    "founded_year": [["founded", "established", "started", "launched", "incorporated"]] * 3 + [["since", "from"]],
}
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
PHONE = r"(\+?\d{1,2}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})"

# Words that add to the confidence of structured data wherever they stand.
STRUCTURED_WORDS = ["employeeCount", "revenue", "founded", "industry", "contactPoint", "location", "logo"]

# Gates and weights.
GATE_STRUCTURED, GATE_META, GATE_HEURISTIC, GATE_EXTERNAL = 0.7, 0.5, 0.7, 0.6
HEURISTIC_WEIGHTS = {"industry": 0.3, "employees": 0.2, "revenue_band": 0.1, "contact_name": 0.15, "contact_title": 0.1, "founded_year": 0.15}
HEURISTIC_CAP = 0.9
PREFERRED_INDUSTRIES = ["Software", "SaaS", "Technology", "Fintech", "Healthcare", "E-commerce", "AI", "Data"]
PREFERRED_SIZES = ["11-50", "51-200", "201-500"]
CRITERIA = {"industry_match": (0.25, 25.0), "company_size": (0.20, 20.0), "email_quality": (0.15, 15.0), "scrape_quality": (0.15, 15.0), "enrichment_quality": (0.15, 15.0), "linkedin_presence": (0.10, 10.0)}
CONFIDENCE_THRESHOLD = 0.6
LABELS = [(80.0, "Hot Lead"), (60.0, "Warm Lead"), (40.0, "Cold Lead")]
LABEL_BELOW = "Disqualified"

# Plans.
PLAN_LIMITS = {"free": 10, "pro": 500, "enterprise": 10000}
PLAN_PRICES = {"free": 0, "pro": 29, "enterprise": 99}
PRICE_PLANS = {"price_123": "starter", "price_456": "pro", "price_789": "enterprise"}

# Wording of messages; {contact}, {company}, {industry}, {website} and {sender} are filled in.
SENDER = "Our Company"
TEMPLATES = {
    "software": "Hi {contact},\n\nI came across {company} in the software space and was impressed by your work. At {sender}, we help software companies optimize their operations and growth. I'd love to explore how we might add value to {company}'s journey.\n\nBest regards,\n{sender}",
    "consulting": "Hi {contact},\n\nI noticed {company} in the consulting field and thought there might be synergies with our work at {sender}. We specialize in helping consulting firms enhance their client value proposition. Would you be open to a brief conversation?\n\nBest regards,\n{sender}",
    "ecommerce": "Hi {contact},\n\nI discovered {company} in the e-commerce space and was intrigued by your approach. {sender} works with e-commerce businesses to streamline their operations and drive growth. I'd be keen to learn more about your current challenges and see if there's alignment with our expertise.\n\nBest regards,\n{sender}",
}
TEMPLATE_INDUSTRY = "Hi {contact},\n\nI came across {company} in the {industry} space and thought there could be value in a brief conversation. We at {sender} work with companies like yours to explore growth and efficiency opportunities.\n\nBest regards,\n{sender}"
TEMPLATE_COMPANY = "Hi {contact},\n\nI discovered {company} and was interested in what you're building. At {sender}, we work with innovative companies to help them achieve their growth objectives. I'd love to learn more about your current initiatives and see if there's potential for collaboration.\n\nBest regards,\n{sender}"
TEMPLATE_WEBSITE = "Hi team,\n\nI visited {website} and was impressed by {company}'s work. At {sender}, we help companies like yours navigate growth challenges and operational efficiencies. I'd be interested in exploring potential synergies.\n\nBest regards,\n{sender}"
NO_CONTACT, NO_COMPANY, NO_WEBSITE = "the team", "your company", "your website"
NO_MESSAGE = "No outreach message generated - AI features not available on your plan"

# The last part of what a language model is asked.
PROMPT = "\nWrite a personalized outreach message from {sender} to {company} that acknowledges their work in {industry}. The message should be professional but not overly formal. Focus on how {sender_org} could provide value to their business."
