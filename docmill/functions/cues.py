"""Word lists by which questions are routed and expanded, Italian and English, in the order of their sources. Every operator takes its own as an argument or by name."""

# Fixed values.
CLASSIFYING_STARTERS = [
    "chi sono", "quali sono", "qual è", "quale è", "what are", "who are", "which are", "what is",
]
REGULATORY_WORDS = [
    "soggetti", "soggetto", "categorie", "categoria", "tipologie", "tipologia", "regime", "vigilanza", "obblighi", "obbligo", "requisiti", "requisito",
    "normativa", "regolamento", "direttiva", "legge", "classificazione", "classifica", "autorità", "responsabilità", "categorie normative", "subjects",
    "entities", "categories", "category", "types", "classification", "supervision", "oversight", "obligations", "requirements", "regulation", "directive",
    "law", "authority", "responsibilities",
]
STRONG_MATH = [
    "formula", "formule", "equazione", "equazioni", "equation", "equations", "disequazione", "disequazioni", "inequality", "inequalities", "algebra",
    "algebrica", "algebrico", "algebricamente", "algebraic", "algebraically", "calcola", "calcolo", "calculate", "compute", "risolvi", "solve",
    "solve for", "deriva", "derivazione", "derive", "esprimi", "express", "in funzione di", "as a function of", "isola", "isolate", "variabile",
    "variabili", "variable", "variables", "percentuale", "percentage", "roi", "rosi", "cvss", "risk score", "probabilità", "probability",
    "calcolo del rischio", "budget", "costo", "costi", "cost", "costs", "quantifica", "quantify", "impatto economico",
]
WEAK_MATH = [
    "sanzione", "sanzioni", "sanzionatorio", "sanzionatoria", "penale", "penali", "multa", "multe", "ammenda", "ammende", "fine", "fines", "sanction",
    "sanctions", "penalty", "penalties", "ammonta", "importo", "amount",
]
AMOUNT_CUES = [
    "calcola", "calcolo", "quantifica", "quanto", "cifra", "esatta", "esatto", "totale", "risultato", "calculate", "compute", "how much", "amount",
    "total", "result",
]
TABLE_CUES = [
    "tabella", "table", "righe", "colonne", "row", "column", "matrice rischi", "risk register", "asset inventory", "inventario", "crosswalk",
    "allineamento", "mappatura",
]
COMPARISON_CUES = [
    "confronta", "confronto", "comparazione", "comparativa", "compare", "comparison", "comparative",
]
CHART_CUES = [
    "grafico", "graph", "flow", "flowchart", "diagramma", "diagram", "architettura", "topologia", "chart", "figura", "rete", "network map", "schema",
    "relazioni", "collegamenti", "nodi", "node", "nodes", "archi", "edge", "edges", "path", "percorso", "traversamento", "multi-hop",
]
AUDIT_CUES = [
    "audit", "compliance", "conformità", "verifica", "valuta", "assessment", "ispeziona", "requisito", "requisiti", "normativa", "regolamento",
    "direttiva", "legge", "iso 27001", "nis2", "gdpr", "dora", "linee guida", "policy", "controllo", "controlli", "violazione", "violazioni", "obbligo",
    "obblighi", "soggetti", "categorie", "categoria", "regime", "vigilanza", "autorità", "responsabilità", "responsabile", "classifica",
    "classificazione",
]
DATA_ACTIONS = [
    "calcola", "calculate", "stima", "estimate", "analizza", "analyse", "analyze", "elabora", "raggruppa", "filtra", "ordina", "confronta", "compare",
    "valuta", "assess", "quantifica", "quantify", "sintetizza", "sintetize",
]
DATA_MEASURES = [
    "totale", "total", "somma", "sum", "media", "mean", "average", "massimo", "minimo", "distribuzione", "distribution", "percentile",
]
DATA_DOMAIN = [
    "vulnerabilità", "vulnerability", "incidenti", "incidents", "cvss", "severità", "severity", "rischio", "risk", "trend", "mitigazione", "mitigation",
]
MATH_TERMS = [
    "calcola", "calcolo", "somma", "moltiplica", "dividi", "sottrai", "matematica", "percentuale", "media", "totale", "operazione", "equivalente",
    "stima", "quantifica", "quantificazione", "costo", "ammonta", "penale", "multa", "calculate", "sum", "multiply", "divide", "subtract", "mathematics",
    "math", "estimate", "quantify", "quantification", "cost", "amount", "penalty", "fine", "percentage", "average", "total", "operation", "equivalent",
    "formula", "equation", "equazione", "theorem", "teorema", "lemma", "proof", "dimostrazione", "integral", "integrale", "derivative", "derivata",
    "logarithm", "logaritmo", "summation", "sommatoria", "matrix", "matrice", "vector", "vettore", "latex", "variance", "varianza", "deviation",
    "deviazione", "correlation", "correlazione", "regression", "regressione", "distribution", "distribuzione", "confidence", "confidenza", "discount",
    "sconto", "yield", "rendimento", "compounding", "capitalization", "amortization", "ammortamento", "present value", "future value", "npv", "van",
    "irr", "tir", "cash flow", "flusso", "sigma", "alpha", "beta", "gamma", "delta", "theta", "lambda",
]
MATH_SIGNS = [
    "%", "+", "=", "*", "/", "∑", "∏", "∫", "√", "≈", "≠", "≤", "≥", "→", "↔", "∩", "∪", "∞", "±", "×", "÷",
]
CALCULATION_VERBS = [
    "calcola", "calcolare", "calcolo", "quantifica", "quantificare", "determina", "determinare", "quanto", "entro quale", "cifra esatta",
    "importo esatto", "tempo totale", "totale cumulativo", "delta", "risultato", "risolvi", "esprimi", "isola", "calculate", "compute", "quantify",
    "determine", "how much", "deadline", "total", "cumulative", "result", "solve", "express", "isolate",
]
ALGEBRA_TERMS = [
    "equazione", "equazioni", "disequazione", "disequazioni", "algebrica", "algebricamente", "in funzione di", "equation", "inequality", "algebraic",
    "as a function of",
]
FORMULA_LOOKUP = [
    "quali formule", "quale formula", "formule presenti", "formula presente", "riporta le formule", "riportale in latex", "estrai le formule",
    "elenca le formule", "quali metriche", "metriche presenti", "modelli matematici presenti", "formule computazionali", "regole di scoring presenti",
    "which formulas", "what formulas", "extract formulas", "list formulas", "formulas in the document", "metrics in the document", "scoring rules",
]
REASONING_TERMS = [
    "spiega", "confronta", "differenza", "differenze", "valuta", "perché", "perche", "correlata", "correlato", "relazione", "analizza", "motivo", "causa",
    "impatto", "conseguenze", "conseguenza", "vantaggi", "svantaggi", "giustifica", "argomenta", "deduci", "collega", "paragona", "distinzione",
    "come funziona", "in che modo", "sintetizza", "riassumi", "scopo", "obiettivo", "soggetti", "categorie", "categoria", "tipologie", "tipologia",
    "classifica", "classificazione", "regime", "vigilanza", "obblighi", "obbligo", "requisiti", "requisito", "normativa", "regolamento", "direttiva",
    "legge", "autorità", "responsabilità", "sanzioni", "sanzione", "explain", "compare", "difference", "differences", "evaluate", "why", "correlated",
    "relation", "relationship", "analyze", "analyse", "reason", "cause", "impact", "consequence", "consequences", "advantage", "advantages",
    "disadvantage", "disadvantages", "justify", "argue", "deduce", "connect", "contrast", "distinction", "how does it work", "in what way", "summarize",
    "summarise", "purpose", "goal", "subjects", "entities", "categories", "category", "types", "classification", "supervision", "oversight",
    "obligations", "obligation", "requirements", "requirement", "regulation", "directive", "law", "authority", "responsibility", "responsibilities",
    "sanctions", "sanction",
]
DEFINITION_TERMS = [
    "cosa significa", "cosa vuol dire", "definisci", "definizione", "significato", "glossario", "cos'è", "cosa è", "chi è", "acronimo", "sta per",
    "cosa si intende", "dizionario", "vocabolario", "termine", "what does it mean", "what is", "who is", "define", "definition", "meaning", "glossary",
    "acronym", "stands for", "what is meant by", "dictionary", "vocabulary", "term",
]
MIXED_GLOSSARY = [
    "usa sia", "usando sia", "insieme ai documenti", "documenti normativi", "documenti recuperati", "fonti recuperate", "contesto documentale",
    "collegamento", "collegamenti", "relazione", "relazioni", "collega", "collegare", "grafo", "entità", "evidenza", "evidenze", "fonte", "fonti",
    "documento", "documenti", "controllo", "controlli", "assessment", "audit", "conformità", "compliance", "using both", "use both",
    "together with documents", "retrieved documents", "retrieved sources", "documentary context", "normative documents", "relationship", "relationships",
    "relation", "relations", "connect", "connection", "connections", "graph", "entity", "entities", "evidence", "evidences", "source", "sources",
    "document", "documents", "control", "controls", "requirement", "requirements",
]
MANY_DOCUMENTS = [
    "documenti", "fonti", "normative", "normativa", "standard", "framework", "regolamenti", "regolamento", "documentazione", "policy", "direttive",
    "direttiva", "linee guida", "allegati", "architettura", "manuale", "guida", "procedure", "procedura", "requisiti", "requisito", "specifiche",
    "corpus", "assessment", "audit", "ispezione", "certificazione", "documents", "sources", "regulations", "regulation", "documentation", "policies",
    "directives", "directive", "guidelines", "attachments", "architecture", "manual", "guide", "procedures", "requirements", "requirement",
    "specifications", "reference materials", "confronta", "confronto", "differenza", "differenze", "integra", "integrazione", "mappa", "mappatura",
    "matrice", "correlazione", "incrocia", "valutazione", "valuta", "allineamento", "sintesi", "riassunto", "sovrapposizione", "congiunta", "compare",
    "comparison", "difference", "differences", "integrate", "integration", "map", "mapping", "matrix", "crosswalk", "correlate", "correlation",
    "cross-reference", "evaluate", "evaluation", "alignment", "summary", "overview", "overlap", "joint", "passo-passo", "fasi", "fase", "completo",
    "completa", "intero", "intera", "dettagliato", "dettagliata", "olistico", "tutto il processo", "dall'inizio alla fine", "step-by-step", "phases",
    "phase", "complete", "entire", "detailed", "comprehensive", "holistic", "in-depth", "end-to-end", "start to finish", "whole process",
    "full walkthrough",
]
GRAPH_TERMS = [
    "neo4j", "cypher", "grafo", "grafi", "relazioni", "relazione", "collegamenti", "collegamento", "entità", "nodi", "nodo", "graph", "relations",
    "relation", "entities", "entity", "links", "link", "nodes", "node", "edges", "edge", "topology", "semantica", "semantico", "semantic", "semantics",
    "ontologia", "ontologie", "ontology", "ontologies", "grafo della conoscenza", "knowledge graph", "rete semantica", "semantic network", "triple",
    "tripla", "triples", "tassonomia", "tassonomie", "taxonomy", "taxonomies", "gerarchia", "gerarchie", "hierarchy", "hierarchies", "alberatura",
    "tree structure", "dipendenze", "dependencies",
]
NORM_TERMS = [
    "conformità", "conforme", "obbligo", "obblighi", "obbligatorio", "adempimento", "adempimenti", "prescrizione", "prescrizioni", "compliance",
    "compliant", "obligation", "obligations", "mandatory", "fulfillment", "enforcement", "normativa", "normative", "normativo", "regolamento",
    "regolamenti", "regolamentazione", "direttiva", "direttive", "legge", "leggi", "legislazione", "decreto", "decreti", "framework", "standard",
    "policy", "policies", "clausola", "clausole", "articolo", "commi", "comma", "allegato", "norm", "norms", "regulation", "regulations", "regulatory",
    "directive", "directives", "law", "laws", "legislation", "decree", "decrees", "clause", "clauses", "article", "articles", "annex", "appendix",
    "audit", "auditor", "ispezione", "ispezioni", "ispettivo", "assessment", "controllo", "controlli", "misura", "misure", "verifica", "verifiche",
    "certificazione", "certificazioni", "attestazione", "governance", "inspection", "inspections", "inspector", "control", "controls", "measure",
    "measures", "verification", "verifications", "certification", "certifications", "attestation", "requisito", "requisiti", "violazione", "violazioni",
    "non-conformità", "sanzione", "sanzioni", "multa", "multe", "infrazione", "infrazioni", "penale", "penali", "responsabilità", "data breach",
    "requirement", "requirements", "violation", "violations", "non-compliance", "sanction", "sanctions", "fine", "fines", "infringement", "breach",
    "penalty", "penalties", "liability", "accountability",
]
FOLLOW_UP = [
    "questo documento", "questa fonte", "questo file", "lo stesso", "la stessa", "sempre lì", "nella stessa", "nel documento precedente", "come sopra",
    "riguardo a prima", "e in questo", "in quest'ultimo", "riguardo quest'ultimo", "ancora qui", "approfondisci questo", "su questo", "di questo",
    "in merito", "this document", "this source", "this file", "the same", "in the same", "previous document", "previous source", "as above",
    "regarding the latter", "in this one", "elaborate on this", "same file", "about this", "on this", "in the previous",
]
AUDIT_MODE = [
    "verifica conformità", "valutazione conformità", "non conformità", "non conforme", "audit", "evidenze implementazione", "evidenza", "evidenze",
    "policy contro evidenza", "tier b", "tier c", "gap tecnico", "gap analysis", "analisi dei gap", "scostamento", "discrepanza", "ispezione",
    "allineamento tecnico", "deviazione", "compliance check", "compliance assessment", "non-compliance", "non-compliant", "implementation evidence",
    "evidence", "policy vs evidence", "technical gap", "deviation", "discrepancy", "inspection", "technical alignment",
]
CHECKLIST_STRONG = [
    "checklist", "crosswalk", "matrice", "matrix", "griglia", "grid",
]
CHECKLIST_WEAK = [
    "assessment", "evidenze", "evidenza", "controlli", "controllo", "requisiti", "requisito", "audit", "linee guida", "elenco", "lista", "kpi",
    "indicatori", "indicatore", "questionario", "domande", "evidence", "controls", "control", "requirements", "requirement", "guidelines", "list",
    "indicators", "indicator", "questionnaire", "checkpoints", "questions",
]
ABSENCE_CHECKS = [
    "se non è presente", "se non e presente", "se non presente", "non è presente", "non e presente", "dichiaralo esplicitamente",
    "dichiara esplicitamente", "voce non presente", "termine non presente", "obbligo previsto", "qual è l'obbligo previsto", "qual e l'obbligo previsto",
    "if not present", "if it is not present", "not present", "not found", "explicitly state",
]
EXPLICIT_GRAPH = [
    "neo4j", "cypher", "grafo", "interroga neo4j", "usando neo4j", "archi", "arco", "nodi", "nodo", "path", "percorso", "traversamento", "multi-hop",
    "catena semantica", "relazioni esplicite", "relazioni nel grafo", "tabella relazioni", "graph", "query neo4j", "using neo4j", "cypher query", "nodes",
    "node", "edges", "edge", "traversal", "semantic chain", "explicit relationships", "relationship table",
]
ANALYSIS_TERMS = [
    "spiega", "valuta", "confronta", "differenza", "differenze", "se", "basandoti", "analizza", "perché", "motivo", "causa", "giustifica", "descrivi",
    "sintetizza", "racconta", "scenario", "ipotesi", "explain", "evaluate", "compare", "difference", "differences", "if", "based on", "analyze",
    "analyse", "why", "reason", "cause", "justify", "describe", "summarize", "summarise", "hypothesis", "what happens",
]
RELATION_TERMS = [
    "neo4j", "cypher", "grafo", "grafi", "relazioni", "relazione", "collegamenti", "collegamento", "entità", "concettuale", "concettuali", "collega",
    "connessione", "connessioni", "nodo", "nodi", "archi", "arco", "mappa", "mappatura", "topologia", "ontologia", "tassonomia", "rete semantica",
    "triple", "graph", "graphs", "entity", "entities", "relationship", "relationships", "relation", "relations", "link", "links", "connect", "connection",
    "connections", "conceptual", "node", "nodes", "edge", "edges", "map", "mapping", "topology", "ontology", "taxonomy", "semantic network", "triples",
]
EXPLANATORY_TERMS = [
    "qual è", "quale è", "quali sono", "che cosa", "cosa significa", "ruolo", "scopo", "funzione", "descrivi", "spiega", "analizza", "valuta",
    "giustifica", "perché", "perche", "in che modo", "come funziona", "elabora", "sintetizza", "what is", "what are", "role", "purpose", "function",
    "describe", "explain", "analyze", "analyse", "evaluate", "justify", "why", "how does", "how do", "summarize", "summarise",
]
STRONG_GRAPH = [
    "relazioni tra", "collegamenti tra", "mostra le relazioni", "traccia la catena", "connessioni", "mappa", "mappatura", "rete semantica", "triple",
    "relations between", "links between", "show relationships", "trace the chain", "connections", "mapping", "semantic network", "triples",
]
EXPLICIT_FORMULA = [
    "formula", "formule", "equazione", "equazioni", "disequazione", "disequazioni", "algebra", "algebrica", "algebrico", "algebricamente", "esprimi",
    "isola", "in funzione di", "risolvi", "deriva", "derivazione", "scrivi la disequazione", "scrivi l'equazione", "equation", "equations", "inequality",
    "inequalities", "algebraic", "algebraically", "solve", "solve for", "derive", "express", "as a function of", "formulas",
]
STRICT_CALCULATION = [
    "calcola", "calcolo", "quantifica", "quanto vale", "cifra esatta", "importo esatto", "risultato", "percentuale", "budget", "roi", "rosi",
    "probabilità", "calcolo del rischio", "calculate", "compute", "quantify", "how much", "exact amount", "result", "percentage", "risk score",
    "probability",
]
MAPPING_TERMS = [
    "crosswalk", "mapping", "mappatura", "mappa", "matrice", "matrix", "collega", "collegare", "allinea", "allineamento", "correlazione",
]
FRAMEWORK_TERMS = [
    "iso", "nist", "annex", "csf", "800-53", "clausola", "clause", "controlli", "controls",
]
EVIDENCE_TERMS = [
    "evidenza", "evidenze", "prova", "prove", "log", "configurazione", "configurazioni", "implementazione", "implementato", "tecnico", "tecniche",
    "screenshot", "dimostra", "dimostrazione", "sistema", "sistemi", "applicato", "registri", "ticket", "verificare", "verifica", "mostrami", "estratto",
    "script", "codice", "firewall", "regola", "regole", "auditare", "ispezionare", "traccia", "tracciamento", "evidence", "evidences", "proof", "logs",
    "configuration", "configurations", "implementation", "implemented", "technical", "demonstrate", "system", "applied", "records", "registry", "verify",
    "show me", "extract", "code", "rule", "rules", "audit", "inspect", "trace", "tracking",
]
CUSTOMER = [
    "cliente", "account cliente", "azienda cliente", "organizzazione", "tenant", "sottoscrittore", "client", "customer", "customer account",
    "client organization", "subscriber",
]
ADMIN = [
    "amministratore", "admin", "chi compra la licenza", "acquirente della licenza", "titolare della licenza", "responsabile licenza", "administrator",
    "license buyer", "license purchaser", "license owner", "license manager",
]
INCIDENT = [
    "incidente", "violazione", "breach", "data breach", "compromissione", "attacco informatico", "evento di sicurezza", "fuga di dati", "incident",
    "compromise", "cyber attack", "security event", "data leak", "security incident",
]
CONTROL = [
    "controllo", "misura", "mitigazione", "salvaguardia", "contromisura", "presidio", "misura di sicurezza", "policy", "procedura", "control", "measure",
    "mitigation", "safeguard", "countermeasure", "security measure", "security control", "procedure",
]
ASSET = [
    "asset", "risorsa", "dispositivo", "bene", "infrastruttura", "sistema", "resource", "device", "infrastructure", "system", "equipment",
]
RISK = [
    "rischio", "minaccia", "vulnerabilità", "falla", "impatto", "criticita", "criticità", "risk", "threat", "vulnerability", "flaw", "impact",
    "criticality",
]
DETECTION_CUES = [
    "tempo di rilevamento", "tempi di rilevamento", "tempo medio di rilevamento", "rilevamento", "detection time", "time to detect",
    "mean time to detect", "detect time",
]
RESOLUTION_CUES = [
    "tempo di risoluzione", "tempi di risoluzione", "tempo medio di risoluzione", "tempo di riparazione", "tempi di riparazione", "risoluzione",
    "riparazione", "resolution time", "time to resolution", "mean time to resolution", "repair time", "time to repair", "mean time to repair",
]
THRESHOLD_CUES = [
    "soglia", "soglie", "utenti impattati", "utenti coinvolti", "utenti interessati", "utenti nell'unione", "utenti nell’unione", "obbligo di notifica",
    "obblighi di notifica", "notifica incidenti", "notifica degli incidenti", "incidente significativo", "incidenti significativi", "threshold",
    "thresholds", "affected users", "impacted users", "notification obligation", "notification obligations", "incident notification",
    "significant incident", "significant incidents",
]
THRESHOLD_ALIASES = [
    "soglia", "soglie", "utenti", "utenti nell'Unione", "notifica", "obbligo di notifica", "incidente significativo", "incidenti significativi",
    "threshold", "affected users", "incident notification", "significant incident", "oltre il 5%", "oltre 1 milione", "milione di utenti",
    "mercato online", "motore di ricerca online", "piattaforma di servizi di social network",
]
WEAK_CONCEPTS = [
    "tutti", "tutto", "all", "each", "ogni", "fattore", "fattori", "factor", "factors", "access", "accesso", "control", "controllo", "controlli",
    "autenticazione", "authentication", "rischio", "risk", "utente", "user", "identity", "identità", "documenti", "documents", "normativi", "normative",
    "funzione", "function", "processo", "process",
]
GENERIC_FORMULA_NAMES = [
    "", "formula/metric", "formula recuperata", "contenuto", "variabili", "metrica/indicatore citato", "formula", "metric",
    "formule e modelli matematici", "formule e modelli matematici - pagina 12 --", "formule e modelli matematici - pagina 24 --", "elemento recuperato",
]

# The verbs that make a text with signs a calculation, the names of a glossary, and nouns without meaning in a graph.
OPERATIONAL_VERBS = ["calcola", "risolvi", "scrivi", "esprimi", "isola", "verifica", "determina", "derive", "solve", "express", "calculate", "compute", "determine"]
GLOSSARY_NAMES = ["glossario", "voce di glossario", "voci di glossario", "glossary", "glossary entry", "term definition"]
GRAPH_NOISE = [
    "usa", "usare", "spiega", "spiegare", "collegamenti", "collegamento", "relazioni", "relazione", "documenti", "documento", "normativi", "normativo", "glossario", "fonti", "fonte", "tabella",
    "using", "use", "explain", "relationship", "relationships", "relation", "relations", "retrieved", "documents", "document", "sources", "source", "glossary", "table",
]

# Terms of finance and signs that make a text mathematical by themselves.
MATH_PATTERN = r"(?i)(formulae\s+sheet|maths\s+tables|economic\s+order\s+quantity|miller[-.\s]?orr|capm|wacc|asset\s+beta|growth\s+model|fisher\s+formula|purchasing\s+power\s+parity|\bbeta\b|standard\s+deviation|\b2c0d\b|[∀-⋿]|[∑∏∫√≈≠≤≥→↔∩∪∞±×÷]|[0-9)][•–—˜][0-9])"

# What a role found in a question adds to its tokens.
ROLE_TOKENS = [(CUSTOMER, "customer_account"), (ADMIN, "admin"), (INCIDENT, "securityincident"), (CONTROL, "securitycontrol"), (ASSET, "asset"), (RISK, "risk")]
DETECTION_ALIASES = ["MTTD", "Mean Time to Detect", "tempo medio impiegato per rilevare", "tempo medio di rilevamento"]
RESOLUTION_ALIASES = ["MTTR", "Mean Time to Resolution", "Mean Time to Repair", "tempo medio necessario per risolvere", "tempo medio di risoluzione", "tempo medio di riparazione"]
DETECTION_RESOLUTION = r"rilevament[oa]\s*/\s*risoluzion[ea]|detect(?:ion)?\s*/\s*resolution"

# Variants of concepts in both languages; each of a group stands for the others.
ACCESS_CONTROL = ["access control", "controllo accessi", "controllo degli accessi", "controlli di accesso", "controlli degli accessi"]
PRIVILEGED_ASKED = ["account privilegiati", "account privilegiato", "privileged account", "privileged accounts"]
PRIVILEGED = [*PRIVILEGED_ASKED, "utenze privilegiate", "utenze con privilegi", "privilegi amministrativi", "administrative privileges"]
UNAUTHORIZED_ASKED = ["accesso non autorizzato", "unauthorized access"]
UNAUTHORIZED = ["accesso non autorizzato", "rischio di accesso non autorizzato", "unauthorized access", "unauthorized access risk", "rischio di accesso"]

# What asks for a chain of several relations, inside a word too.
MULTI_HOP = ["multi-hop", "multihop", "catena", "percorso", "path", "traversamento", "chain", "traversal"]
