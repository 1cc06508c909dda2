"""Fixed values.

Word lists, label tables and keyword groups that have to hold exactly these
entries for the results to be right.  Every function that uses one of them also
takes a replacement as a parameter.
"""

# English stopwords.
STOPWORDS = """
a an the and or but in on at to for
of with by from as is was are were been
be have has had do does did will would
could should may might must shall can need
it its this that these those i you he
she we they me him her us them my your
his our their what which who whom when where
why how all each every both few more most
other some such no nor not only own same
so than too very just also now here there
then once if about into through during before
after above below between under again further
while any because being having doing am up
down out off over under get got etc ie
eg via vs per de la le les
""".split()

# HTML entities, decoded in this order.
HTML_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
]

# Raw label -> canonical label.
LABEL_MAP = {
    "data engineer": "Data Engineer",
    "Data engineer": "Data Engineer",
    "devops engineer": "DevOps Engineer",
    "Devops engineer": "DevOps Engineer",
    "DevOps engineer": "DevOps Engineer",
    "ml engineer": "ML Engineer",
    "ML engineer": "ML Engineer",
    "software engineer": "Software Engineer",
    "Software engineer": "Software Engineer",
    "frontend developer": "Front End Developer",
    "Frontend developer": "Front End Developer",
    "backend developer": "Backend Developer",
    "Backend developer": "Backend Developer",
    "full stack developer": "Full Stack Developer",
    "Full stack developer": "Full Stack Developer",
    "fullstack developer": "Full Stack Developer",
    "Fullstack developer": "Full Stack Developer",
    "mobile developer": "Mobile Developer",
    "Mobile developer": "Mobile Developer",
    "data science": "Data Science",
    "Data science": "Data Science",
    "ACCOUNTANT": "Accountant",
    "ADVOCATE": "Advocate",
    "AGRICULTURE": "Agriculture",
    "APPAREL": "Apparel",
    "ARTS": "Arts",
    "AUTOMOBILE": "Automobile",
    "AVIATION": "Aviation",
    "BANKING": "Banking",
    "BPO": "Bpo",
    "BUSINESS-DEVELOPMENT": "Business-Development",
    "CHEF": "Chef",
    "CONSTRUCTION": "Construction",
    "CONSULTANT": "Consultant",
    "DESIGNER": "Designer",
    "DIGITAL-MEDIA": "Digital-Media",
    "ENGINEERING": "Engineering",
    "FINANCE": "Finance",
    "FITNESS": "Fitness",
    "HEALTHCARE": "Healthcare",
    "HR": "HR",
    "INFORMATION-TECHNOLOGY": "Information-Technology",
    "PUBLIC-RELATIONS": "Public-Relations",
    "SALES": "Sales",
    "TEACHER": "Teacher",
    "Health and fitness": "Fitness",
    "Web Designing": "Designer",
    "Electrical Engineering": "Engineering",
    "Civil Engineer": "Engineering",
    "Mechanical Engineer": "Engineering",
    "Python Developer": "Python Developer",
    "Java Developer": "Java Developer",
    "Web Developer": "Web Developer",
    "Front End Developer": "Front End Developer",
    "Software Developer": "Software Developer",
    "Database Administrator": "Database Administrator",
    "Network Administrator": "Network Administrator",
    "Systems Administrator": "Systems Administrator",
    "Security Analyst": "Security Analyst",
    "Project Manager": "Project Manager",
    "hr": "HR",
    "Hr": "HR",
    "pmo": "PMO",
    "Pmo": "PMO",
}

# Optional further label rows (off by default).
EXTRA_LABEL_MAP = {
    "sap developer": "SAP Developer",
    ".NET Developer": "DotNet Developer",
    ".Net Developer": "DotNet Developer",
    "Dotnet Developer": "DotNet Developer",
    "Devops Engineer": "DevOps Engineer",
}

# Domain -> specialisation -> leaf labels, and the root.
ROOT_LABEL = "Professional"
UNKNOWN_LABEL = "Unknown"
TAXONOMY = {
    "Technology": {
        "Software Development": [
            "Python Developer", "Java Developer", "DotNet Developer",
            "Software Developer", "Blockchain",
        ],
        "Web Development": ["Web Developer", "Front End Developer", "Designer"],
        "Data & Analytics": [
            "Data Science", "ETL Developer", "Hadoop", "Database",
            "Database Administrator",
        ],
        "Infrastructure & DevOps": [
            "DevOps Engineer", "Network Security Engineer",
            "Network Administrator", "Systems Administrator",
            "Security Analyst", "SAP Developer",
        ],
        "Quality Assurance": ["Testing", "Automation Testing"],
        "General IT": ["Information-Technology"],
        "Project Management": ["Project Manager"],
    },
    "Engineering": {"Engineering": ["Engineering"]},
    "Business & Management": {
        "Business Analysis": ["Business Analyst", "Consultant"],
        "Management": ["Operations Manager", "PMO", "Business-Development"],
        "Sales & Marketing": ["Sales", "Public-Relations", "Digital-Media"],
    },
    "Finance & Legal": {
        "Finance": ["Finance", "Banking", "Accountant"],
        "Legal": ["Advocate"],
    },
    "Healthcare & Services": {
        "Healthcare": ["Healthcare", "Fitness"],
        "Human Resources": ["HR"],
        "Hospitality": ["Chef"],
        "Arts & Design": ["Arts"],
    },
    "Specialized Industries": {
        "Education": ["Teacher"],
        "Construction": ["Construction"],
        "Agriculture": ["Agriculture"],
        "Aviation": ["Aviation"],
        "Retail": ["Apparel"],
    },
}

# Keyword groups, matched as substrings of the lower-cased text.
KEYWORD_GROUPS = {
    "automobile": [
        "automobile", "automotive", "mechanic", "vehicle", "car technician",
        "auto repair", "auto body", "car dealer", "truck driver", "transporter",
    ],
    "bpo": [
        "bpo", "business process", "call center", "customer service outsourcing",
        "bpo operations", "bpo manager", "contact center",
    ],
    "it": [
        "software", "developer", "programmer", "engineer", "python", "java",
        "javascript", "react", "angular", "node", "database", "sql", "api",
        "backend", "frontend", "devops", "cloud", "aws", "azure",
    ],
    "data": [
        "data scientist", "data analyst", "machine learning", "etl", "datastage",
        "informatica", "data warehouse", "analytics", "bi developer",
    ],
    "finance": [
        "claims", "insurance", "underwriter", "actuary", "policy", "adjuster",
        "usaa", "financial analyst", "accountant",
    ],
    "legal": ["attorney", "lawyer", "legal", "paralegal", "law firm"],
    "hr": ["recruiter", "hr ", "human resources", "talent acquisition", "staffing"],
    "admin": [
        "administrative", "secretary", "office manager", "coordinator",
        "executive assistant", "receptionist",
    ],
}

# Label suggested when a group outscores the automobile group,
# in the order in which ties are decided.
SUGGESTED_LABELS = [
    ("it", "Information-Technology"),
    ("data", "Data Science"),
    ("finance", "Finance"),
    ("legal", "Advocate"),
    ("hr", "HR"),
    ("admin", "Operations Manager"),
]

# Phrases of the insurer rule.
INSURER_PHRASES = ["usaa", "united services automobile"]
INSURANCE_WORDS = ["claims", "insurance"]

# Strings a CSV field may hold to mean "missing".
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
