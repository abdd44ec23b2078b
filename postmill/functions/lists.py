"""Word lists and patterns that results depend on, in natural order."""

COMPANY_SUFFIXES = "inc llc ltd corp co gmbh plc pty pvt sa ag nv bv ab oy".split()
WORK_MODE_WORDS = ["remote", "hybrid", "on[- ]?site", "wfh", "work from home", "telecommute"]

CATEGORIES = {
    "data_ml_ai": ["data scientist", "data science", "machine learning", "ml engineer", "ai engineer", "nlp engineer", "deep learning", "llm engineer", "data engineer", "data analyst", "analytics engineer", "research scientist", "applied scientist", "quantitative researcher", "research engineer", "ai/ml", "ml/ai"],
    "devops_infra": ["devops", "site reliability engineer", "sre", "infrastructure engineer", "platform engineer", "cloud engineer", "reliability engineer", "build engineer", "network engineer", "systems administrator", "sysadmin", "storage engineer", "database administrator", "dba"],
    "security": ["security engineer", "security analyst", "security architect", "security researcher", "cybersecurity", "infosec", "penetration test", "soc analyst", "security grc", "information security"],
    "product_mgmt": ["product manager", "product owner", "product lead"],
    "design_ux": ["ux designer", "ui designer", "product designer", "graphic designer", "visual designer", "ux researcher", "ui/ux", "user experience designer", "creative director", "art director"],
    "management": ["engineering manager", "technical lead manager", "program manager", "project manager", "director", "vice president", "head of", "cto", "ceo", "cfo", "cpo", "cio"],
    "software_eng": ["software engineer", "software developer", "full stack", "fullstack", "full-stack", "frontend engineer", "frontend developer", "backend engineer", "backend developer", "mobile engineer", "mobile developer", "ios engineer", "ios developer", "android engineer", "android developer", "web developer", "web engineer", "robotic software", "simulation software"],
}
EMPLOYMENT_LABELS = {
    "full_time": ["full time", "full-time", "fulltime", "permanent", "regular"],
    "part_time": ["part time", "part-time", "parttime"],
    "contract": ["contract", "contractor", "freelance", "consultant", "b2b", "c2c", "1099"],
    "internship": ["intern", "internship", "co-op", "coop", "working student", "werkstudent"],
    "temporary": ["temporary", "temp", "seasonal", "fixed term", "fixed-term"],
}
EMPLOYMENT_IN_TITLE = {
    "internship": ["intern", "internship", "co-op", "co op", "coop"],
    "contract": ["contract", "contractor", "c2c", "1099", "freelance", "temp-to-perm", "temp to perm", "contract-to-hire", "contract to hire"],
    "part_time": ["part-time", "part time"],
    "temporary": ["temporary", "seasonal", "fixed-term", "fixed term"],
}
EMPLOYMENT_IN_TEXT = {
    "internship": ["internship", "intern position", "summer intern"],
    "contract": ["contract position", "contract role", "contract opportunity", "this is a contract", "w2 contract", "month contract", "contract-to-hire", "contract to hire"],
    "part_time": ["part-time", "part time"],
    "temporary": ["temporary position", "seasonal", "fixed-term", "fixed term"],
}
NEW_GRAD = ["new grad", "new graduate", "new-grad", "newgrad", "new college grad", "recent graduate", "recent grad", "university graduate", "university grad", "early career", "early-career", "earlycareer", "rotational program", "rotation program", "graduate program", "grad program", "graduate rotational", "campus hire", "campus recruit", "university recruiting", "university program", "leadership development program", "entry level program", "entry-level program", "apprenticeship", "apprentice program"]
NEW_GRAD_LABEL = r"(?i)\b(?:employee type|career level|job level|position type)\s*:?\s*(?:new college grad|new grad(?:uate)?|early[ -]career)\b"
REMOTE_WORDS = {"remote": ["remote", "work from home", "wfh", "distributed"], "hybrid": ["hybrid"], "onsite": ["onsite", "on-site", "on site", "office", "in-person"]}

US_NAMES = ["us", "usa", "u.s.", "u.s.a.", "united states", "united states of america", "america"]
US_STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
US_STATE_NAMES = ["alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia"]
US_CITIES = ["san francisco", "seattle", "new york", "brooklyn", "boston", "austin", "los angeles", "san diego", "denver", "atlanta", "dallas", "houston", "portland", "philadelphia", "phoenix", "pittsburgh", "minneapolis", "nashville", "charlotte", "raleigh", "durham", "mountain view", "palo alto", "sunnyvale", "menlo park", "santa clara", "bellevue", "chicago", "salt lake city", "san mateo", "redwood city"]
GENERIC_REMOTE = ["", "fully", "flexible", "distributed", "home", "home based", "work from home", "wfh", "us", "usa", "united states", "america", "north america", "americas", "us based", "us only", "usa only", "remote us"]
FOREIGN_PLACES = ["afghanistan", "argentina", "australia", "austria", "bangladesh", "belgium", "brazil", "bulgaria", "canada", "chile", "china", "colombia", "costa rica", "croatia", "czech republic", "czechia", "denmark", "ecuador", "egypt", "estonia", "finland", "france", "germany", "greece", "hong kong", "hungary", "india", "indonesia", "ireland", "israel", "italy", "japan", "kenya", "latvia", "lithuania", "malaysia", "mexico", "netherlands", "new zealand", "nigeria", "norway", "pakistan", "peru", "philippines", "poland", "portugal", "romania", "russia", "saudi arabia", "serbia", "singapore", "slovakia", "slovenia", "south africa", "south korea", "korea", "spain", "sweden", "switzerland", "taiwan", "thailand", "turkey", "ukraine", "united arab emirates", "united kingdom", "uruguay", "vietnam", "emea", "apac", "latam", "ind", "sgp", "gbr", "deu", "chn", "isr", "twn", "kor", "jpn", "vnm", "mys", "phl", "idn", "irl", "esp", "nld", "swe", "prt", "ukr", "tur", "tha", "nzl", "arg", "pak", "bgd", "lka", "egy", "zaf"]
FOREIGN_CITIES = ["montreal", "toronto", "berlin", "munich", "madrid", "barcelona", "bilbao", "amsterdam", "warsaw", "lisbon", "zurich", "stockholm", "copenhagen", "prague", "vienna", "brussels", "busan", "seoul", "hsinchu", "taipei", "tokyo", "osaka", "bangalore", "bengaluru", "hyderabad", "chennai", "mumbai", "pune", "gurgaon", "noida", "tel aviv", "sao paulo", "belo horizonte", "bogota", "buenos aires", "mexico city", "guadalajara", "ho chi minh", "hanoi", "manila", "jakarta", "kyiv", "bucharest", "belgrade", "istanbul", "cairo", "lagos", "nairobi", "sydney", "auckland"]

NO_SPONSORSHIP = (
    r"(?i)\b(?:no|without|cannot|can't|unable to|will not|does not|don't)\b[^.\n]{0,90}\b(?:visa|immigration|employment)\s+sponsor(?:ship|ing)?\b"
    r"|\b(?:visa\s+|immigration\s+|employment\s+)?sponsorship\b[^.\n]{0,60}\bnot\b[^.\n]{0,20}\b(?:available|offered|provided|possible)\b"
    r"|\bwithout\b[^.\n]{0,45}\bsponsorship\b"
    r"|\b(?:must|require)\b[^.\n]{0,70}\b(?:permanent|unrestricted|indefinite)\b[^.\n]{0,55}\bwork(?:ing)?\s+authorization\b"
)
CITIZENSHIP = (
    r"(?i)\b(?:u\.?s\.?\s*(?:citizen|citizens)|us\s*(?:citizen|citizens)|u\.?s\.?\s*person|green\s*card\s*(?:holder|holders|only|required)|permanent\s+resident(?:s)?\s+only)\b"
    r"|\b(?:itar|ear|export[- ]control(?:led)?)\b"
)
CLEARANCE = (
    r"(?i)\b(?:active|current|existing|valid|required)\b[^.\n]{0,65}\b(?:security\s+clearance|ts/sci|top\s+secret|secret\s+clearance)\b"
    r"|\b(?:security\s+clearance|ts/sci|top\s+secret|secret\s+clearance)\b[^.\n]{0,65}\b(?:required|must|active|current)\b"
)
DEFENCE_WORDS = (
    r"(?i)\b(?:weapon(?:s)?\s+system|missile|munition|warfighter|itar|ear\s+(?:compliance|regulations)|us\s+persons?\s+(?:only|status|requirement)|cleared\s+facility|clearance[- ]eligible"
    r"|ability\s+to\s+obtain\s+a?\s*(?:security\s+)?clearance|unmanned\s+(?:air(?:craft)?|aerial)\s+(?:system|vehicle)|\buas\b|\buav\b|electronic\s+warfare|radar\s+(?:system|sensor)|rf\s+sensor"
    r"|defen[sc]e\s+(?:contractor|industry|sector|program)s?)\b"
)
DEFENCE_COMPANIES = ["northrop grumman", "lockheed martin", "raytheon", "rtx", "l3harris", "l3harris technologies", "leidos", "bae systems", "general dynamics", "general atomics", "anduril", "anduril industries", "ultra", "ultra intelligence and communications", "cubic", "the aerospace corporation", "aerospace corporation", "draper", "mitre", "booz allen hamilton", "caci", "saic", "peraton", "sierra nevada corporation", "spacex"]

SENIORITY_RANK = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "staff": 4, "lead": 4, "principal": 5, "manager": 5, "director": 6, "vp": 7, "c_level": 8}
#: From the most senior, as the first that fits counts; of equal rank the first counts.
TITLE_SENIORITY = {
    "c_level": r"\b(?:chief|ceo|cto|cio|cdo|cfo|cpo)\b",
    "vp": r"\b(?:vice[ -]president|vp)\b",
    "director": r"\b(?:director|head of)\b",
    "principal": r"\bprincipal\b",
    "manager": r"\bmanager\b",
    "staff": r"\b(?:staff|distinguished)\b|\b(?:engineer|scientist|analyst|developer)\s+(?:iv|4)\b|\blevel\s+(?:iv|4)\b",
    "lead": r"\b(?:lead|tech lead|technical lead)\b",
    "senior": r"\b(?:senior|sr\.?)\b|\b(?:engineer|scientist|analyst|developer)\s+(?:iii|3)\b|\blevel\s+(?:iii|3)\b",
    "mid": r"\bmid[ -]level\b|\b(?:engineer|scientist|analyst|developer)\s+(?:ii|2)\b|\blevel\s+(?:ii|2)\b",
    "junior": r"\b(?:junior|jr\.?|entry[ -]level|new[ -]grad|associate)\b|\b(?:engineer|scientist|analyst|developer)\s+(?:i|1)\b|\blevel\s+(?:i|1)\b",
    "intern": r"\b(?:intern|internship|co-op)\b",
}
ROLE_FAMILIES = {
    "ml_engineering": r"\b(?:machine learning|ml|ai|artificial intelligence|deep learning|nlp|llm|computer vision)\s+(?:engineer|developer)\b",
    "data_science": r"\b(?:data scientist|data science|applied scientist)\b",
    "data_engineering": r"\b(?:data engineer|analytics engineer|etl engineer|data platform engineer)\b",
    "research": r"\b(?:research engineer|research scientist|quantitative researcher)\b",
    "analytics": r"\b(?:data analyst|business intelligence|bi analyst|reporting analyst)\b",
    "infrastructure": r"\b(?:infrastructure|platform|site reliability|sre|devops|cloud|systems?)\s+(?:engineer|developer|administrator|architect)\b",
    "security": r"\b(?:security|cybersecurity|infosec|soc)\s+(?:engineer|analyst|researcher|architect)\b",
    "software": r"\b(?:software|backend|front[ -]?end|full[ -]?stack|web|mobile|ios|android)\s+(?:engineer|developer)\b",
    "product": r"\b(?:product manager|product owner)\b",
    "business_ops": r"\b(?:business analyst|operations analyst|strategy analyst|consultant)\b",
    "qa": r"\b(?:qa|quality assurance|test(?:ing)?|sdet|test automation)\s+(?:engineer|analyst|developer)\b|\bsdet\b",
    "embedded": r"\b(?:embedded|firmware|fpga|rtl)\s+(?:engineer|developer)\b",
    "solutions": r"\b(?:solutions?|sales)\s+(?:architect|engineer)\b",
    "design": r"\b(?:product|ux|ui|visual|graphic|brand)\s+designer\b|\bux researcher\b",
}
SPECIALTIES = {
    "embedded/firmware": (r"\b(?:embedded|firmware|rtos)\b", ["embedded", "firmware", "rtos", "microcontroller"]),
    "genomics/bioinformatics": (r"\b(?:genomics?|bioinformatics|computational biology|rna-seq|ngs)\b", ["genomics", "bioinformatics", "computational biology", "rna-seq", "ngs"]),
    "quantitative finance": (r"\b(?:quantitative (?:trading|finance)|algorithmic trading|trade lifecycle)\b", ["quantitative finance", "quantitative trading", "algorithmic trading", "trade lifecycle"]),
    "cybersecurity": (r"\b(?:cybersecurity|security|penetration test)\b", ["cybersecurity", "security operations", "penetration testing", "infosec"]),
    "mobile": (r"\b(?:ios|android|mobile)\s+(?:engineer|developer)\b", ["ios", "android", "swift", "kotlin", "react native", "flutter"]),
    "enterprise platform (ERP/HCM/CRM)": (r"\b(?:oracle\s+(?:cloud\s+)?(?:hcm|fusion|erp)|sap(?:\s+\w+)?|peoplesoft|workday\s+(?:hcm|integration|configuration)|servicenow|salesforce)\b", ["oracle hcm", "oracle fusion", "sap", "peoplesoft", "workday", "servicenow", "salesforce"]),
}
SKILL_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "k8s": "kubernetes", "kube": "kubernetes", "postgres": "postgresql", "psql": "postgresql", "pg": "postgresql", "sklearn": "scikit-learn",
    "scikit learn": "scikit-learn", "ml": "machine learning", "dl": "deep learning", "nlp": "natural language processing", "cv": "computer vision", "ds": "data science", "ai": "artificial intelligence",
    "genai": "generative ai", "llm": "large language models", "llms": "large language models", "tf": "tensorflow", "gcp": "google cloud", "gcs": "google cloud", "aws": "amazon web services", "az": "azure",
    "k8": "kubernetes", "ci/cd": "cicd", "ci cd": "cicd", "node": "nodejs", "node.js": "nodejs", "react.js": "react", "reactjs": "react", "next.js": "nextjs", "golang": "go", "c++": "cpp", "c#": "csharp",
    ".net": "dotnet", "rest api": "rest", "restful": "rest", "spark": "apache spark", "pyspark": "apache spark", "tf2": "tensorflow", "torch": "pytorch", "huggingface": "hugging face", "sb3": "stable-baselines3", "rl": "reinforcement learning",
    "powerbi": "power bi", "power-bi": "power bi", "gen ai": "generative ai", "rag": "rag pipelines", "llmops": "large language models", "sklearn pipelines": "scikit-learn", "ms sql": "sql server",
    "postgres sql": "postgresql", "etl pipelines": "etl", "data pipelines": "etl", "ci-cd": "cicd", "github actions": "cicd", "sagemaker": "amazon web services", "databricks": "apache spark",
}
SKILL_IMPLIED_BY = {
    "machine learning": ["pytorch", "tensorflow", "keras", "scikit-learn", "xgboost", "cnn", "deep learning", "computer vision", "natural language processing", "reinforcement learning", "stable-baselines3"],
    "deep learning": ["pytorch", "tensorflow", "keras", "cnn"],
    "artificial intelligence": ["machine learning", "deep learning", "large language models", "generative ai", "pytorch", "tensorflow"],
    "data science": ["pandas", "numpy", "scikit-learn", "machine learning", "statistics", "r"],
    "generative ai": ["large language models", "langchain", "claude api", "openai api", "fine-tuning", "rag pipelines"],
    "large language models": ["langchain", "claude api", "openai api", "rag pipelines", "prompt engineering", "generative ai"],
    "cloud": ["amazon web services", "azure", "google cloud", "docker", "vercel"],
    "reinforcement learning": ["stable-baselines3", "gymnasium", "ppo", "q-learning"],
    "computer vision": ["opencv", "cnn", "resnet", "albumentations", "pytorch"],
    "natural language processing": ["large language models", "transformers", "hugging face", "spacy", "nltk"],
    "etl": ["apache spark", "pandas", "airflow", "clickhouse", "sql"],
    "transfer learning": ["pytorch", "tensorflow", "keras", "resnet", "hugging face"],
    "mlops": ["docker", "cicd", "github actions", "mlflow"],
    "statistics": ["hypothesis testing", "regression", "r", "statistical modeling"],
    "data visualization": ["tableau", "power bi", "matplotlib", "seaborn", "plotly"],
}
