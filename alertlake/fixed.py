"""Fixed values.

Everything in this module is a constant that results depend on (word lists,
lookup tables, patterns, prompt texts, weights). It holds no logic.
"""

# --- fixed values: enumerations -------------------------------------------------
SEVERITIES = ("Low", "Medium", "High", "Critical")
DEFAULT_SEVERITY = "Medium"
DEFAULT_TITLE = "Unknown Alert"
GRADES = ("BenignPositive", "FalsePositive", "TruePositive")  # position = class id
STATUS_TRIAGED = "Triaged"
STATUS_CLOSED = "Closed_FP"
MISSING = "__MISSING__"

# --- fixed values: where each vendor keeps each canonical field -----------------
VENDOR_PATHS = {
    "wazuh": {
        "alert_id": ("id",),
        "title": ("rule", "description"),
        "severity": ("rule", "level"),
        "mitre_tactic": ("rule", "mitre", "tactic"),
        "mitre_technique": ("rule", "mitre", "id"),
        "ip_address": ("data", "srcip"),
        "user_name": ("data", "srcuser"),
        "device_name": ("agent", "name"),
        "timestamp": ("timestamp",),
        "category": ("rule", "groups"),
    },
    "splunk": {
        "alert_id": ("sid",),
        "title": ("search_name",),
        "severity": ("result", "urgency"),
        "ip_address": ("result", "src_ip"),
        "user_name": ("result", "user"),
        "device_name": ("result", "host"),
        "timestamp": ("_time",),
        "category": ("result", "source"),
    },
    "elastic_siem": {
        "alert_id": ("kibana", "alert", "uuid"),
        "title": ("kibana", "alert", "rule", "name"),
        "severity": ("kibana", "alert", "severity"),
        "mitre_tactic": ("kibana", "alert", "rule", "threat", "tactic", "name"),
        "mitre_technique": ("kibana", "alert", "rule", "threat", "technique", "id"),
        "ip_address": ("source", "ip"),
        "user_name": ("user", "name"),
        "device_name": ("host", "name"),
        "timestamp": ("@timestamp",),
        "category": ("event", "category"),
    },
    "crowdstrike": {
        "alert_id": ("composite_id",),
        "title": ("display_name",),
        "severity": ("max_severity_displayname",),
        "mitre_tactic": ("tactic",),
        "mitre_technique": ("technique_id",),
        "ip_address": ("local_ip",),
        "user_name": ("user_name",),
        "device_name": ("computer_name",),
        "file_hash": ("sha256",),
        "timestamp": ("created_timestamp",),
    },
}

# --- fixed values: vendor severity words and level bands ------------------------
SEVERITY_WORDS = {
    "splunk": {
        "informational": "Low", "low": "Low", "medium": "Medium",
        "high": "High", "critical": "Critical",
    },
    "elastic_siem": {
        "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical",
    },
    "crowdstrike": {
        "informational": "Low", "low": "Low", "medium": "Medium",
        "high": "High", "critical": "Critical",
    },
}
SEVERITY_BANDS = {
    "wazuh": ((0, 3, "Low"), (4, 7, "Medium"), (8, 11, "High"), (12, 15, "Critical")),
}

# --- fixed values: canonical alert fields ---------------------------------------
CANONICAL_FIELDS = (
    "alert_id", "tenant_id", "timestamp", "source", "normalized_title", "severity",
    "raw_data", "mitre_tactic", "mitre_technique", "entity_type", "device_name",
    "ip_address", "user_name", "file_hash", "url", "domain", "category",
    "threat_family", "suspicion_level", "dedup_key",
)
ENVELOPE_FIELDS = ("vendor", "tenant_id", "raw", "timestamp")

# --- fixed values: feature table -------------------------------------------------
IDENTIFIER_COLUMNS = ("Id", "IncidentId", "AlertId", "ActionGrouped", "ActionGranular")
SPARSE_COLUMNS = (
    "EmailClusterId", "ThreatFamily", "ResourceType", "Roles",
    "AntispamDirection", "SuspicionLevel", "LastVerdict",
)
CATEGORY_COLUMNS = (
    "OrgId", "DetectorId", "AlertTitle", "Category", "EntityType", "EvidenceRole",
    "DeviceId", "Sha256", "IpAddress", "Url", "AccountSid", "AccountUpn",
    "AccountObjectId", "AccountName", "DeviceName", "NetworkMessageId",
    "EmailClusterId", "RegistryKey", "RegistryValueName", "RegistryValueData",
    "ApplicationId", "ApplicationName", "OAuthApplicationId", "ThreatFamily",
    "FileName", "FolderPath", "ResourceIdName", "ResourceType", "Roles", "OSFamily",
    "OSVersion", "AntispamDirection", "SuspicionLevel", "LastVerdict", "CountryCode",
    "State", "City",
)
NUMERIC_FEATURES = (
    "hour_of_day", "day_of_week", "month", "has_mitre", "mitre_technique_count",
    "has_EmailClusterId", "has_ThreatFamily", "has_ResourceType", "has_Roles",
    "has_AntispamDirection", "has_SuspicionLevel", "has_LastVerdict",
)
FEATURES = NUMERIC_FEATURES + CATEGORY_COLUMNS
SUSPICION_ORDINAL = {"Low": 0.0, "Medium": 0.33, "High": 0.66, "Critical": 1.0}
CANONICAL_ALIASES = {
    "AlertTitle": ("normalized_title",),
    "Category": ("category",),
    "EntityType": ("entity_type",),
    "Sha256": ("file_hash",),
    "IpAddress": ("ip_address",),
    "Url": ("url",),
    "DeviceName": ("device_name",),
    "ThreatFamily": ("threat_family",),
    "SuspicionLevel": ("suspicion_level", "severity"),
}
RAW_ALIASES = {
    "AlertTitle": (("rule", "description"),),
    "Category": (("rule", "groups"), ("event", "category")),
    "DeviceName": (("agent", "name"), ("host", "name")),
    "IpAddress": (("data", "srcip"), ("source", "ip")),
    "AccountName": (("data", "dstuser"), ("data", "srcuser"), ("user", "name")),
    "FileName": (("data", "filename"),),
    "FolderPath": (("data", "path"),),
}

# --- fixed values: scores (decimal text, so that sums stay exact) ---------------
HEURISTIC_SCORES = {"Critical": "0.90", "High": "0.70", "Medium": "0.40", "Low": "0.10"}
ASSET_BASE = {"Critical": "0.95", "High": "0.75", "Medium": "0.50", "Low": "0.25"}
BEHAVIOUR_BASE = {"Critical": "0.95", "High": "0.70", "Medium": "0.45", "Low": "0.20"}
ASSET_WORDS_STREAM_HIGH = (
    "domain controller", "active directory", "exchange", "database", "backup", "admin",
)
ASSET_WORDS_STREAM_LOW = ("server", "firewall", "gateway", "dns")
ASSET_WORDS_SINGLE = ("domain controller", "exchange", "database", "admin")
TACTIC_WORDS_HIGH = ("lateral", "exfiltration", "impact")
TACTIC_WORDS_LOW = ("execution", "persistence", "privilege")
TITLE_WORDS_STREAM = ("brute force", "multiple fail", "repeated", "credential")
TITLE_WORDS_SINGLE = ("brute force", "lateral", "exfiltration")
KEYWORD_TITLE_WORDS = ("brute force", "injection", "malware", "unauthorized")
RISK_WEIGHTS = ("0.5", "0.3", "0.2")
AUTO_CLOSE_SCORE = 0.01
AUTO_CLOSE_RISK = 35

# --- fixed values: entity labels and tags ---------------------------------------
TAGS = (
    "O", "B-Malware", "I-Malware", "B-Indicator", "I-Indicator", "B-System",
    "I-System", "B-Vulnerability", "I-Vulnerability", "B-Organization",
    "I-Organization",
)  # position = tag id
SPAN_TYPE_LABELS = {
    "Malware": "Malware", "Vulnerability": "Vulnerability", "System": "System",
    "Organization": "Organization", "Person": "Organization", "Device": "System",
    "Software": "System",
}
LABEL_IOC_TYPES = {
    "Malware": "malware_name", "Indicator": "indicator", "System": "hostname",
    "Vulnerability": "cve", "Organization": "organization",
}

# --- fixed values: patterns of whole indicator values ---------------------------
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
IPV6 = "|".join((
    r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}",
    r"([0-9a-fA-F]{1,4}:){1,7}:",
    r"([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}",
    r"([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}",
    r"([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}",
    r"([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}",
    r"([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}",
    r"[0-9a-fA-F]{1,4}:(:[0-9a-fA-F]{1,4}){1,6}",
    r":((:[0-9a-fA-F]{1,4}){1,7}|:)",
))
SHA256 = r"[a-fA-F0-9]{64}"
SHA1 = r"[a-fA-F0-9]{40}"
MD5 = r"[a-fA-F0-9]{32}"
CVE = r"(?i:CVE)-\d{4}-\d{4,}"
URL = r"https?://\S+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
VALUE_PATTERNS = (  # tested in this order, anchored
    (IPV4, "IP_Address"), (IPV6, "IP_Address"), (SHA256, "File_Hash"),
    (SHA1, "File_Hash"), (MD5, "File_Hash"), (CVE, "CVE_ID"), (URL, "URL"),
    (EMAIL, "Email_Address"), (DOMAIN, "Domain"),
)
# --- fixed values: patterns searched inside one span ----------------------------
SPAN_PATTERNS = (
    (IPV4, "IP_Address"), (SHA256, "File_Hash"), (SHA1, "File_Hash"),
    (MD5, "File_Hash"), (CVE, "CVE_ID"), (URL, "URL"), (EMAIL, "Email_Address"),
)
# --- fixed values: patterns searched in whole texts for missed indicators -------
RECOVERY_PATTERNS = (
    (CVE, "CVE_ID", "Vulnerability"),
    (rf"(?<![a-fA-F0-9]){SHA256}(?![a-fA-F0-9])", "File_Hash", "Indicator"),
    (rf"(?<![a-fA-F0-9]){SHA1}(?![a-fA-F0-9])", "File_Hash", "Indicator"),
    (rf"\b{IPV4}\b", "IP_Address", "Indicator"),
    (r"\bhttps?://[^\s\"'<>]+", "URL", "Indicator"),
    (rf"\b{EMAIL}\b", "Email_Address", "Indicator"),
)
HASH_CONTEXT_WORDS = ("hash", "sha", "md5", "checksum", "ioc", "indicator", "file")
# --- fixed values: patterns of the rule-only extraction -------------------------
RULE_PATTERNS = (
    (rf"\b{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\b", "Indicator", "IP_Address"),
    (rf"\b{CVE}\b", "Vulnerability", "CVE_ID"),
    (rf"\b{MD5}\b|\b{SHA1}\b|\b{SHA256}\b", "Indicator", "File_Hash"),
    (r"\bhttps?://[^\s]+", "Indicator", "URL"),
    (rf"\b{EMAIL}\b", "Indicator", "Email_Address"),
    (r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b", "Indicator", "Domain"),
)
KNOWN_NAMES = ("Cobalt Strike", "Mimikatz", "Emotet", "TrickBot", "LockBit", "APT29")
CONTEXT_PATTERNS = (
    (r"\b(?:spear\s?-?phishing(?:\s+lure)?|phishing(?:\s+lure)?)\b", "Indicator"),
    (r"\b(?:bulletproof hosting provider|threat actor|adversary)\b", "Organization"),
    (r"\b(?:compromised endpoint|endpoint|domain controller|temp directory|server|host)\b",
     "System"),
    (r"\b(?:suspicious executable|executable|windows dll|dll|powershell)\b", "Tool"),
)
# --- fixed values: event phrases, in order of priority --------------------------
EVENT_PHRASES = (
    ("encrypted", "Ransom"), ("ransomware", "Ransom"), ("ransom", "Ransom"),
    ("phishing", "Phishing"), ("phish", "Phishing"),
    ("credential harvesting", "Phishing"),
    ("exfiltrated", "Databreach"), ("data breach", "Databreach"),
    ("data leak", "Databreach"), ("exfiltration", "Databreach"),
    ("patched", "Patch-Vulnerability"), ("patch", "Patch-Vulnerability"),
    ("remediated", "Patch-Vulnerability"),
    ("disclosed", "Discover-Vulnerability"), ("vulnerability", "Discover-Vulnerability"),
    ("zero-day", "Discover-Vulnerability"), ("0day", "Discover-Vulnerability"),
)
EVENT_CONFIDENCE = 0.7
RULE_EVENT_PHRASES = (
    ("ransomware", "Ransom"), ("spearphishing", "Phishing"),
    ("spear-phishing", "Phishing"), ("phishing", "Phishing"),
    ("exfiltration", "Databreach"), ("data breach", "Databreach"),
    ("brute force", "CredentialAttack"), ("credential theft", "CredentialAttack"),
    ("compromised", "CredentialAttack"), ("lateral", "LateralMovement"),
    ("lateral movement", "LateralMovement"),
)

# --- fixed values: summary clean-up ---------------------------------------------
SUMMARY_PREFIXES = (
    "Summarize the following security incident report:",
    "Summarize the following:",
    "Summary:",
)
CHAT_MARKERS = ("<|user|>", "<|assistant|>", "<|system|>", "```")
OFF_TOPIC_MARKERS = (
    "san francisco", "(kron)", "a new study", "according to a new study",
    "breaking news",
)

# --- fixed values: chat row texts -----------------------------------------------
TRIAGE_SYSTEM = (
    "You are a senior SOC analyst. Your task is to evaluate the following "
    "SIEM alert and classify it as TruePositive or FalsePositive.\n"
    "Respond ONLY with a valid JSON object containing exactly two keys:\n"
    "1. \"grade\": A string, either \"TruePositive\" or \"FalsePositive\".\n"
    "2. \"confidence\": A float between 0.0 and 1.0 representing your confidence.\n"
    "Do not output any markdown formatting, explanation, or other text."
)
ENTITY_SYSTEM = (
    "You are a cybersecurity Named Entity Recognition (NER) extractor.\n"
    "Extract all STIX 2.1 aligned entities from the text. "
    "Valid labels are: Malware, Indicator, System, Vulnerability, Organization.\n"
    "Also extract any broad Security Events (e.g., Ransomware, Phishing, Backdoor).\n"
    "Respond ONLY with a valid JSON object matching this schema:\n"
    "{\n"
    "  \"entities\": [\n"
    "    {\"text\": \"string\", \"label\": \"string\", \"ioc_type\": \"string\"}\n"
    "  ],\n"
    "  \"events\": [\n"
    "    {\"type\": \"string\", \"keyword\": \"string\"}\n"
    "  ]\n"
    "}\n"
    "Do not output any markdown formatting, explanation, or other text."
)
SUMMARY_SYSTEM = (
    "You are a cybersecurity analyst. Your task is to summarize the following "
    "security incident report.\n"
    "Provide a detailed analyst summary in 8 to 15 sentences, covering all technical details.\n"
    "Be completely factual. Do not hallucinate any details, IPs, or actors not present in the text.\n"
    "Respond ONLY with the summary text. Do not include any JSON formatting or preamble."
)
