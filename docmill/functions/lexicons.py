"""The default word lists, patterns and lookup tables of the operators. Every operator takes its own as an argument."""

# Folder, tier, content type, source kind.
TAXONOMY = [
    ("norm_frameworks_intl", "A", "framework", "global_standard"),
    ("norm_regulations_local", "A", "regulation", "legal_requirement"),
    ("norm_audit_guidelines", "A", "guideline", "best_practice"),
    ("gov_infosec_policies", "B", "policy", "internal_governance"),
    ("gov_it_procedures", "B", "procedure", "internal_governance"),
    ("gov_bcdr_plans", "B", "bcdr_plan", "internal_governance"),
    ("gov_hr_policies", "B", "hr_policy", "internal_governance"),
    ("gov_org_charts_roles", "B", "org_chart", "internal_governance"),
    ("tech_evidence_sys_config", "C", "sys_config", "technical_evidence"),
    ("tech_evidence_audit_logs", "C", "audit_log", "technical_evidence"),
    ("tech_evidence_vuln_patching", "C", "vuln_report", "technical_evidence"),
    ("tech_evidence_backup_restore", "C", "backup_log", "technical_evidence"),
    ("tech_evidence_net_access", "C", "network_config", "technical_evidence"),
    ("org_evidence_mgmt_reviews", "C", "mgmt_review", "organizational_evidence"),
    ("org_evidence_training_aware", "C", "training_log", "organizational_evidence"),
    ("org_evidence_incident_rep", "C", "incident_ticket", "organizational_evidence"),
    ("org_evidence_risk_mgmt", "C", "risk_register", "organizational_evidence"),
    ("legal_evidence_vendor_contracts", "C", "vendor_contract", "legal_evidence"),
    ("legal_evidence_data_privacy", "C", "privacy_record", "legal_evidence"),
    ("legal_evidence_nda_clauses", "C", "nda_agreement", "legal_evidence"),
    ("phys_evidence_env_controls", "C", "env_control", "physical_evidence"),
    ("phys_evidence_access_logs", "C", "access_log", "physical_evidence"),
]

# Headings that mark a structural page.
STRUCTURAL = "Contents|Index|Bibliography|Acknowledgements|Glossary|Appendix|Reference|Table of Contents|Indice|Sommario|Bibliografia|Ringraziamenti|Appendice|Riferimenti"

# Keywords of assessment and compliance texts.
KEYWORDS = [
    "policy", "procedura", "procedure", "guideline", "standard", "normativa", "framework",
    "rischio", "risk", "vulnerabilità", "minaccia", "threat", "mitigazione",
    "incidente", "incident", "breach", "data breach", "violazione",
    "accesso", "access", "autenticazione", "mfa", "password", "crittografia", "encryption",
    "backup", "restore", "ripristino", "disaster recovery", "business continuity",
    "audit", "assessment", "conformità", "compliance", "non-conformità",
    "asset", "server", "network", "firewall", "log", "monitoraggio",
    "formazione", "training", "awareness", "dipendente", "fornitore", "vendor",
]

# Lines that repeat on every page.
PAGE_FURNITURE = ["formulae sheet", "maths tables", "s17"]

# Marks of a broken text layer.
BROKEN_MARKS = ["2C0D", "•", "–", "—", "˜", "× ×", "( ) ( )"]

# Words of quantitative reasoning.
MATH_WORDS = [
    "formula", "equation", "equazione", "theorem", "teorema", "lemma", "proof", "dimostrazione",
    "integral", "integrale", "derivative", "derivata", "logarithm", "logaritmo", "summation", "sommatoria",
    "matrix", "matrice", "vector", "vettore", "variance", "varianza", "deviation", "deviazione",
    "correlation", "correlazione", "regression", "regressione", "distribution", "distribuzione", "confidence", "confidenza",
    "discount", "sconto", "yield", "rendimento", "compounding", "capitalization", "amortization", "ammortamento",
    "present value", "future value", "npv", "van", "irr", "tir", "cash flow", "flusso",
    "sigma", "alpha", "beta", "gamma", "delta", "theta", "lambda",
]
MATH_SYMBOLS = "∑∏∫√∂∇∆∀∃∈∉⊆⊂∪∩≠≈≤≥±∓∞∝∠⊥∥"

# Marks of visual and table chunks.
VISUAL_MARKS = ["### 🖼️ VISUAL ANALYSIS", "VISUAL ANALYSIS:", "*Visual Elements:*", "--- CONTENUTO VISUALE", "--- ANALISI VISUALE", "--- CONTENUTO VISIVO", "--- ASSET VISIVO", "!["]
VISION_MARKS = ["### 🖼️ VISUAL ANALYSIS", "*Visual Elements:*", "*Data Insights:*", "ANALISI VISIVA"]
TABLE_MARKS = ["|---", "| ---", "data_table_md"]
VISUAL_WORDS = "asse|assi|axis|axes|legenda|legend|grafico|chart|plot|pendenza|slope|barre|bars"

# Entities too general to carry meaning.
STOP_ENTITIES = ["dato", "dati", "sistema", "sistemi", "azienda", "aziende", "utente", "utenti", "informazione", "informazioni", "documento", "data", "system", "company", "user", "information", "document"]
GENERIC_CATEGORIES = ["GENERIC", "YEAR", "DATE"]

# Topic, patterns.
TOPICS = [
    ("Governance_Policies", ["policy", "procedura", "standard", "guideline", "linea guida", "regolamento", "direttiva", "manuale", "organigramma", "ruoli e responsabilità", "segregation of duties", "sod"]),
    ("Risk_Management", ["rischio", "risk", "minaccia", "threat", "vulnerabilità", "vulnerability", "mitigazione", "risk assessment", "trattamento del rischio", "risk register", "matrice dei rischi"]),
    ("Compliance_Audit", ["iso 27001", "iso 27002", "gdpr", "nis2", "dora", "nist", "audit", "assessment", "conformità", "compliance", "non-conformità", "certificazione", "ispezione", "evidenza"]),
    ("Business_Continuity_DR", ["business continuity", "disaster recovery", "bcp", "drp", "backup", "ripristino", "restore", "rto", "rpo", "resilienza", "copia di sicurezza", "continuità operativa"]),
    ("Incident_Management", ["incidente", "incident", "data breach", "violazione", "anomalia", "segnalazione", "incident response", "triage", "compromissione"]),
    ("Access_Identity_Control", ["accesso", "access control", "autenticazione", "mfa", "password", "identità", "iam", "credenziali", "privilegi", "active directory", "logon", "sso"]),
    ("Technical_Network_Security", ["firewall", "crittografia", "encryption", "siem", "log", "monitoraggio", "patch", "endpoint", "antivirus", "malware", "rete", "vlan", "vpn", "vulnerability scan", "penetration test", "pt"]),
    ("HR_Awareness_Security", ["formazione", "training", "awareness", "consapevolezza", "assunzione", "onboarding", "offboarding", "nda", "codice etico", "dipendente", "phishing", "risorse umane"]),
    ("Vendor_SupplyChain_Security", ["fornitore", "vendor", "supply chain", "terze parti", "sla", "provider", "supply chain security", "third-party risk", "contratto", "outsourcing", "subfornitore", "cloud provider", "dpa", "data processing agreement", "soc 2", "audit fornitore"]),
    ("Physical_Environmental_Security", ["sicurezza fisica", "controlli ambientali", "badge", "videosorveglianza", "cctv", "sala server", "datacenter", "estintori", "ups", "condizionamento"]),
]

# Question words that retrieval ignores.
STOP_WORDS = [
    "della", "delle", "degli", "dello", "dalla", "dalle", "dagli", "nella", "nelle", "negli", "nello", "alla", "alle", "agli", "sulla", "sulle", "sugli", "sullo",
    "questo", "questa", "questi", "queste", "quello", "quella", "quelli", "quelle", "sono", "presenti", "presente", "ciascuna", "ciascuno", "tutti", "tutte",
    "quale", "quali", "cosa", "come", "dove", "quando", "perché", "perche", "spiega", "spiegami", "riporta", "riportale", "mostra", "mostrami",
    "dimmi", "elenca", "trova", "cerca", "voglio", "vorrei", "fammi", "riguardo", "inerente", "relativo", "secondo", "base", "basandoti",
    "what", "which", "where", "when", "explain", "show", "tell", "list", "find", "search", "report", "present", "available", "each", "about",
    "these", "those", "this", "that", "there", "their", "would", "could", "should", "please", "according", "regarding", "based", "give",
    "documento", "documenti", "file", "fonte", "fonti", "testo", "riferisce", "document", "documents", "source", "sources", "text", "context",
    "pagina", "pag", "page", "pages", "paragrafo", "sezione", "capitolo", "chapter", "section", "paragraph",
    "formula", "formule", "matematica", "matematiche", "latex", "concetto",
]

# Words of a threshold rule.
THRESHOLD_WORDS = ["oltre", "superiore", "almeno", "non inferiore", "maggiore di", "greater than", "over", "more than", "at least", "threshold", "soglia", "condizione", "condition"]
THRESHOLD_UNITS = "%|per cento|percent|milione|milioni|million|millions"
#: K-7's terms: comparatives, limits and words of rules, Italian and English.
THRESHOLD_SCAN_TERMS = ["oltre", "superiore", "almeno", "inferiore", "maggiore", "minore", "massimo", "minimo", "limite", "soglia", "eccede", "eccedente", "supera", "superamento", "fino a", "tetto", "cap", "tolleranza", "margine", "range", "intervallo", "compreso tra", "al di sopra", "al di sotto", "non più di", "non meno di", "pari o superiore", "pari o inferiore", "franchigia", "massimale", "greater than", "over", "less than", "at least", "threshold", "limit", "maximum", "minimum", "exceeds", "exceeding", "surpasses", "up to", "ceiling", "tolerance", "margin", "interval", "between", "above", "below", "under", "no more than", "no less than", "equal to", "condizione", "regola", "legge", "requisito", "obbligo", "criterio", "parametro", "vincolo", "direttiva", "normativa", "regolamento", "standard", "policy", "procedura", "prescrizione", "disposizione", "norma", "articolo", "comma", "decreto", "provvedimento", "linea guida", "conformità", "adempimento", "metrica", "indicatore", "kpi", "sla", "misura", "clausola", "certificazione", "target", "condition", "rule", "law", "requirement", "obligation", "criterion", "parameter", "constraint", "directive", "regulation", "procedure", "prescription", "provision", "act", "measure", "guideline", "compliance", "fulfillment", "benchmark", "metric", "indicator", "clause", "certification"]

# Words that make a line a metric's, and metrics that are reported as missing when a question names them.
METRIC_WORDS = [
    "formula", "formulas", "formulae", "equation", "equations", "formule", "equazione", "equazioni", "metric", "metrics", "metrica", "metriche", "indicator", "indicators", "indicatore", "indicatori",
    "score", "scoring", "punteggio", "calculation", "calculation model", "calcolo", "modello di calcolo", "mean time", "tempo medio", "index", "indice", "ratio", "coverage", "copertura", "maturity", "maturità", "severity", "severità",
]
REQUESTED_METRICS = ["cvss", "rischio", "risk", "maturità", "maturity", "copertura", "coverage", "severity", "severità"]

# What makes a page a candidate for charts, and for formulas (words as patterns, then marks).
CHART_PAGE_WORDS = [
    "chart", "graph", "figure", "plot", "diagram", "heatmap", "risk matrix", "control matrix", "dashboard", "flowchart", "network diagram", "architecture", "timeline", "asset inventory", "axis", "legend",
    "grafico", "grafica", "figura", "plot", "diagramma", "matrice rischi", "matrice di rischio", "matrice controlli", "dashboard", "cruscotto", "flusso", "rete", "architettura", "timeline", "inventario asset", "asse", "legenda",
]
FORMULA_PAGE_PATTERNS = [
    "formulae\\s+sheet", "maths\\s+tables", "cvss", "risk\\s+score", "impact\\s*[x×*]\\s*likelihood", "inherent\\s+risk", "residual\\s+risk", "rto", "rpo", "control\\s+effectiveness", "maturity\\s+score", "sla", "severity\\s+score",
    "2c0d", "standard\\s+deviation", "likelihood", "impact", "exposure", "[\\u2200-\\u22FF]", "[∑∏∫√=≈≠≤≥→↔∩∪∞±×÷]", "[•–—˜]",
]
