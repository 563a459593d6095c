"""Codes, patterns, labels and thresholds that results depend on.

Everything here is data that downstream consumers compare literally (rule and
reason codes, messages, regular expressions, thresholds).  No logic lives here.
"""

from __future__ import annotations

SCHEMA_VERSION = "2.0"

# -- fields of a record: (column name, public path), in record order ----------
FIELDS = [
    ("issuer_name", "issuer.name"),
    ("issuer_cnpj", "issuer.cnpj"),
    ("isin", "security.isin"),
    ("ticker", "security.ticker"),
    ("share_class", "security.share_class"),
    ("listing_segment", "security.listing_segment"),
    ("asset_status", "security.asset_status"),
    ("event_type", "corporate_action.event_type"),
    ("approval_date", "corporate_action.dates.approval_date"),
    ("record_date", "corporate_action.dates.record_date"),
    ("ex_date", "corporate_action.dates.ex_date"),
    ("payment_date", "corporate_action.dates.payment_date"),
    ("credit_date", "corporate_action.dates.credit_date"),
    ("fraction_period_start", "corporate_action.dates.fraction_period_start"),
    ("fraction_period_end", "corporate_action.dates.fraction_period_end"),
    ("gross_amount_per_share", "corporate_action.financials.gross_amount_per_share"),
    ("net_amount_per_share", "corporate_action.financials.net_amount_per_share"),
    ("tax_rate_percent", "corporate_action.financials.tax_rate_percent"),
    ("tax_treatment", "corporate_action.financials.tax_treatment"),
    ("currency", "corporate_action.financials.currency"),
    ("ratio", "corporate_action.financials.ratio"),
    ("attributed_cost_per_share", "corporate_action.financials.attributed_cost_per_share"),
]
REFERENCE_ONLY_FIELDS = ["listing_segment", "asset_status"]
PATH_OF = dict(FIELDS)
FIELD_OF = {path: name for name, path in FIELDS}
EXTRACTED_FIELDS = [name for name, _ in FIELDS if name not in REFERENCE_ONLY_FIELDS]
EXTRACTED_PATHS = [PATH_OF[name] for name in EXTRACTED_FIELDS]
DECIMAL_FIELDS = [
    "gross_amount_per_share",
    "net_amount_per_share",
    "tax_rate_percent",
    "attributed_cost_per_share",
]

# -- closed vocabularies --------------------------------------------------------
CASH_EVENTS = ["DIVIDEND", "JCP"]
RATIO_EVENTS = ["BONUS_SHARES", "STOCK_SPLIT", "REVERSE_SPLIT"]
EVENT_TYPES = ["DIVIDEND", "JCP", "BONUS_SHARES", "STOCK_SPLIT", "REVERSE_SPLIT", "OTHER", "UNKNOWN"]
UNRESOLVED_STATUSES = ["UNKNOWN", "AMBIGUOUS", "CONFLICT", "UNREADABLE"]
REPLACEABLE_STATUSES = ["UNKNOWN", "AMBIGUOUS", "UNREADABLE"]
DOCUMENT_STATUSES = ["EXTRACTED", "NOT_DISCLOSED", "AMBIGUOUS", "CONFLICT", "UNREADABLE"]

# Material fields: always, then by event type.
MATERIAL_ALWAYS = ["issuer_name", "isin", "ticker", "event_type", "approval_date"]
MATERIAL_BY_EVENT = {
    "DIVIDEND": ["record_date", "ex_date", "payment_date", "gross_amount_per_share", "currency"],
    "JCP": ["record_date", "ex_date", "payment_date", "gross_amount_per_share", "currency"],
    "BONUS_SHARES": ["record_date", "ex_date", "ratio"],
    "STOCK_SPLIT": ["record_date", "ratio"],
    "REVERSE_SPLIT": ["record_date", "ratio"],
}
# Fields the event rule demands (payment date is not among them).
RULE_REQUIRED_BY_EVENT = {
    "DIVIDEND": ["record_date", "ex_date", "gross_amount_per_share", "currency"],
    "JCP": ["record_date", "ex_date", "gross_amount_per_share", "currency"],
    "BONUS_SHARES": ["record_date", "ex_date", "ratio"],
    "STOCK_SPLIT": ["record_date", "ratio"],
    "REVERSE_SPLIT": ["record_date", "ratio"],
}
# Routing's critical fields and the names printed in its messages.
CRITICAL_ALWAYS = [
    ("issuer.name", "issuer_name"),
    ("security.isin", "isin"),
    ("security.ticker", "ticker"),
    ("corporate_action.event_type", "event_type"),
    ("dates.approval_date", "approval_date"),
    ("dates.record_date", "record_date"),
    ("dates.ex_date", "ex_date"),
]
CRITICAL_CASH = ("financials.gross_amount_per_share", "gross_amount_per_share")
CRITICAL_RATIO = ("financials.ratio", "ratio")

# -- thresholds -----------------------------------------------------------------
CONFIDENCE_THRESHOLD = 75
FUZZY_THRESHOLD = 0.72
FUZZY_TOP = 3
NATIVE_TEXT_MIN_CHARS = 80
OCR_MIN_ALNUM = 80
TEXT_BUDGET_CHARS = 40000
MAX_PAGE_WORDS = 2000
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MONEY_TOLERANCE = "0.0000005"
BASIC_PASSES = 2

# -- golden table -----------------------------------------------------------------
GOLDEN_CSV_COLUMNS = {
    "emissor": "issuer",
    "cnpj": "cnpj",
    "isin": "isin",
    "ticker": "ticker",
    "classe": "share_class",
    "segmento_listagem": "listing_segment",
    "status": "status",
}
GOLDEN_COLUMNS = list(GOLDEN_CSV_COLUMNS.values())
ACTIVE_STATUS = "ativo"
# identifier of the golden table -> record field, in comparison order
IDENTIFIERS = {
    "issuer": "issuer_name",
    "cnpj": "issuer_cnpj",
    "isin": "isin",
    "ticker": "ticker",
    "share_class": "share_class",
}
CONFLICT_CODES = {
    "issuer": "REF_ISSUER_CONFLICT",
    "cnpj": "REF_CNPJ_CONFLICT",
    "isin": "REF_ISIN_CONFLICT",
    "ticker": "REF_TICKER_CONFLICT",
    "share_class": "REF_SHARE_CLASS_CONFLICT",
}
STRONG_CONFLICT_CODE = "REF_STRONG_IDENTIFIER_CONFLICT"
STRONG_CONFLICT_EXPECTED = "ISIN and CNPJ must identify the same record"
SHARE_CLASS_ALIASES = {
    "on": "ON",
    "ordinaria": "ON",
    "acao ordinaria": "ON",
    "acoes ordinarias": "ON",
    "pn": "PN",
    "preferencial": "PN",
    "acao preferencial": "PN",
    "acoes preferenciais": "PN",
    "pna": "PNA",
    "preferencial a": "PNA",
    "pnb": "PNB",
    "preferencial b": "PNB",
    "unit": "UNIT",
    "units": "UNIT",
}

# -- extraction patterns (Java syntax; U = Unicode classes and case folding) ------
_DATE = r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
_MONEY = r"(\d{1,3}(?:\.\d{3})*,\d+)"
PATTERNS = {
    "company_line": r"(?iU)\bS\.?A\.?$",
    "cnpj": r"(?U)\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    "isin": r"(?U)\bBR[A-Z0-9]{10}\b",
    "ticker": r"(?U)\b[A-Z]{4}\d{1,2}\b",
    "share_words": r"(?iU)(?:ação|acoes|ações)\s+(ordinária|preferencial)",
    "share_letters": r"\((ON|PN)\)",
    "approval_date": r"(?iU)Data de aprova[cç][aã]o[^\n]*\s+" + _DATE,
    "record_date": r"(?iU)Data-base(?: do grupamento)?[^\n]*\s+" + _DATE,
    "ex_date": r"(?iU)(?:Data\s+[‘“\"']?ex[^\n]*|In[ií]cio da negocia[cç][aã]o grupada)\s+" + _DATE,
    "payment_date": r"(?iU)Data de pagamento[^\n]*\s+" + _DATE,
    "credit_date": r"(?iU)Cr[eé]dito das a[cç][oõ]es bonificadas[^\n]*\s+" + _DATE,
    "narrative_approval": (
        r"(?iU)(?:reuni[aã]o|Assembleia Geral Extraordin[aá]ria)(?:\s+realizada)?\s+(?:em|de)\s+"
        r"(\d{1,2})\s+de\s+([A-Za-zÀ-ÿ]+)\s+de\s+(\d{4})"
    ),
    "fraction_period": (
        r"(?iU)Per[ií]odo de ajuste de fra[cç][oõ]es[^\n]*\s+"
        r"(\d{1,2}/\d{1,2}/\d{4})\s+a\s+(\d{1,2}/\d{1,2}/\d{4})"
    ),
    "payment_not_disclosed": r"(?iU)data de pagamento ser[aá] [^.\n]*(?:definida|divulgada)[^.\n]*",
    "gross_amount_per_share": r"(?iU)Valor bruto por a[cç][aã]o[^\n]*(?:\s*\([^\n]+\))?\s*R\$\s*" + _MONEY,
    "net_amount_per_share": r"(?iU)Valor l[ií]quido por a[cç][aã]o[^\n]*(?:\s*\([^\n]+\))?\s*R\$\s*" + _MONEY,
    "attributed_cost_per_share": r"(?iU)Custo atribu[ií]do[^\n]*\s*R\$\s*" + _MONEY,
    "tax_rate_percent": r"(?iU)(?:IRRF na fonte|Imposto de Renda Retido na\s+Fonte)\s*(\d+(?:,\d+)?)%",
    "tax_by_beneficiary": (
        r"(?isU)al[ií]quota[^.]{0,300}(?:por benefici[aá]rio|condi[cç][aã]o do benefici[aá]rio)"
    ),
    "tax_uniform": r"(?iU)(?:incidir[aá]|reten[cç][aã]o de)\s+Imposto de Renda[^.\n]*",
    "ratio_colon": r"(?iU)Propor[cç][aã]o\s+(\d+)\s*:\s*(\d+)",
    "ratio_words": (
        r"(?iU)Propor[cç][aã]o\s+(\d+)\s+a[cç][aã]o nova para cada\s+(\d+)\s+a[cç][oõ]es"
        r"(?:\s*\((\d+(?:,\d+)?)%\))?"
    ),
}
# Text every match of a pattern contains one of (case-sensitive for the three
# codes, lower case for the rest); pages without it skip the expression.
PATTERN_LITERALS = {
    "cnpj": ["/"],
    "isin": ["BR"],
    "share_words": ["ordin", "preferencial"],
    "share_letters": ["(ON)", "(PN)"],
    "approval_date": ["data de aprova"],
    "record_date": ["data-base"],
    "ex_date": ["data", "cio da negocia"],
    "payment_date": ["data de pagamento"],
    "credit_date": ["dito das a"],
    "narrative_approval": ["reuni", "assembleia geral extraordin"],
    "fraction_period": ["odo de ajuste de fra"],
    "payment_not_disclosed": ["data de pagamento ser"],
    "gross_amount_per_share": ["valor bruto por a"],
    "net_amount_per_share": ["quido por a"],
    "attributed_cost_per_share": ["custo atribu"],
    "tax_rate_percent": ["irrf na fonte", "imposto de renda retido na"],
    "tax_by_beneficiary": ["quota"],
    "tax_uniform": ["imposto de renda"],
    "ratio_colon": ["propor"],
    "ratio_words": ["nova para cada"],
    "JCP": ["capital pr"],
    "BONUS_SHARES": ["bonifica"],
    "REVERSE_SPLIT": ["grupamento de a", "inplit"],
    "STOCK_SPLIT": ["desdobramento de a", "split"],
    "DIVIDEND": ["dividendo"],
}
CASE_SENSITIVE = ["cnpj", "isin", "ticker", "share_letters"]
# Event patterns, strongest first: the first hit on a page classifies the page.
EVENT_PATTERNS = [
    ("JCP", r"(?iU)juros sobre (?:o )?capital pr[oó]prio|remunera[cç][aã]o do capital pr[oó]prio"),
    ("BONUS_SHARES", r"(?iU)bonifica[cç][aã]o em a[cç][oõ]es"),
    ("REVERSE_SPLIT", r"(?iU)grupamento de a[cç][oõ]es|\binplit\b"),
    ("STOCK_SPLIT", r"(?iU)desdobramento de a[cç][oõ]es|\bsplit\b"),
    ("DIVIDEND", r"(?iU)dividendos?(?:\s+intercalares?)?"),
]
EVENT_SIGNAL_RATIONALE = "Termo econômico explícito identificado pelo extrator Python."
MONTHS = {
    "janeiro": 1,
    "fevereiro": 2,
    "marco": 3,
    "abril": 4,
    "maio": 5,
    "junho": 6,
    "julho": 7,
    "agosto": 8,
    "setembro": 9,
    "outubro": 10,
    "novembro": 11,
    "dezembro": 12,
}

# -- rule prefixes -> fields a rule result is copied to ---------------------------
RULE_PREFIXES = {
    "DATE_APPROVAL": ["approval_date", "record_date"],
    "DATE_RECORD": ["record_date", "ex_date"],
    "DATE_PAYMENT": ["payment_date", "record_date"],
    "FIN_GROSS_NET": ["gross_amount_per_share", "net_amount_per_share", "tax_rate_percent"],
    "FIN_TAX": ["tax_treatment", "net_amount_per_share"],
    "FIN_UNIVERSAL_NET": ["net_amount_per_share"],
    "FIN_CURRENCY": ["currency"],
    "FIN_RATIO": ["ratio"],
    "EVENT_": ["event_type"],
    "REF_ISSUER": ["issuer_name"],
    "REF_CNPJ": ["issuer_cnpj"],
    "REF_ISIN": ["isin"],
    "REF_TICKER": ["ticker"],
    "REF_SHARE_CLASS": ["share_class"],
    "REF_ASSET": ["asset_status"],
}

# -- messages -----------------------------------------------------------------------
MSG_APPROVAL_OK = "Approval date is not after the record date."
MSG_APPROVAL_BAD = "Approval date occurs after the record date."
MSG_RECORD_OK = "Record date occurs before the ex-date."
MSG_RECORD_BAD = "Record date must occur before the ex-date."
MSG_PAYMENT_OK = "Payment date is not before the record date."
MSG_PAYMENT_BAD = "Payment date occurs before the record date."
MSG_PAYMENT_OPEN = "The issuer explicitly states that payment date is not disclosed."
MSG_TAX_OK = "Gross, tax rate, and net amount are mathematically consistent."
MSG_TAX_BAD = "Net amount does not match gross amount after tax."
MSG_TAX_BENEFICIARY = "Tax depends on beneficiary conditions; a universal net amount must not be derived."
MSG_NET_CONDITIONAL = (
    "The net amount is explicitly disclosed for the stated withholding rule, "
    "but may differ for exempt or immune beneficiaries."
)
EXPECT_NET_CONDITIONAL = "Document-disclosed net amount qualified by beneficiary tax treatment"
MSG_NET_UNIVERSAL = (
    "A universal net amount is incompatible with beneficiary-dependent taxation "
    "unless explicitly disclosed."
)
MSG_CURRENCY = "A monetary value was extracted without its currency."
MSG_RATIO_OK = "Corporate action ratio is positive."
MSG_RATIO_BAD = "Corporate action ratio must be positive."
MSG_EVENT_UNKNOWN = "The corporate action type could not be determined."
MSG_EVENT_CONFLICT = "Material classification signals contradict one another."
MSG_EVENT_OK = "No material classification conflict was reported."
MSG_NO_REFERENCE = "No reference record could be confirmed."
MSG_INACTIVE = "The reference record is not active."

REASONS = {
    "EXTRACTION_CASCADE_EXHAUSTED": (
        "REVIEW_EXCEPTION", "The extraction cascade ended with unresolved critical fields."),
    "EVENT_CLASSIFICATION_AMBIGUOUS": (
        "REVIEW_EXCEPTION", "The corporate action type could not be determined."),
    "TITLE_BODY_CLASSIFICATION_CONFLICT": (
        "REVIEW_EXCEPTION", "Material classification evidence is contradictory."),
    "DOCUMENT_CONFIDENCE_BELOW_THRESHOLD": ("REVIEW_EXCEPTION", "Document confidence is below 75%: "),
    "REFERENCE_NOT_FOUND": (
        "VALIDATION_EXCEPTION", "No golden record could be confirmed for the extracted security."),
    "REFERENCE_IDENTIFIER_CONFLICT": (
        "VALIDATION_EXCEPTION", "Extracted identifiers conflict with the golden record."),
    "DATE_SEQUENCE_INCONSISTENT": ("VALIDATION_EXCEPTION", None),
    "FINANCIAL_VALUES_INCONSISTENT": ("VALIDATION_EXCEPTION", None),
    "DOCUMENT_PARTIALLY_UNREADABLE": ("REVIEW_EXCEPTION", "Critical field is unreadable: "),
    "CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD": (
        "REVIEW_EXCEPTION", "Critical field confidence is below 75%: "),
    "PAYMENT_DATE_NOT_DISCLOSED": (
        "BUSINESS_EXCEPTION", "The issuer states that the payment date will be disclosed later."),
}
CONFIDENCE_RATIONALE = (
    " campos materiais foram resolvidos. O score é a média dos percentuais de confiança "
    "dos campos materiais; campos ausentes contribuem com zero."
)

# -- preliminary checks: code -> (message when passed, message/prefix when failed) -----
CHECKS = {
    "REQUIRED_FIELDS": ("Todos os campos materiais foram resolvidos.", "Campos materiais pendentes: "),
    "AGENT_CONSENSUS": (
        "As duas extrações básicas concordam nos campos informados.",
        "Divergência ou ausência de consenso em: "),
    "EVIDENCE_GROUNDING": (
        "Todas as evidências foram localizadas nas páginas citadas.",
        "Evidência não localizada para: "),
    "GOLDEN_VALIDATION": (
        "Identidade confirmada sem conflitos na base de referência.",
        "A identidade não foi confirmada ou diverge da base de referência."),
    "DATE_COHERENCE": ("As relações temporais avaliáveis são coerentes.", "Falharam as regras: "),
    "FINANCIAL_COHERENCE": ("Os valores financeiros avaliáveis são coerentes.", "Falharam as regras: "),
    "CLASSIFICATION_CONSISTENCY": (
        "A classificação não apresenta contradições materiais.", "Falharam as regras: "),
    "OCR_QUALITY": (
        "As páginas lidas por OCR possuem conteúdo suficiente.",
        "OCR de baixa qualidade nas páginas: "),
}
CONSENSUS_TOO_FEW = "respostas básicas insuficientes"

# -- operator-facing labels ---------------------------------------------------------
REASON_LABELS = {
    "EXTRACTION_CASCADE_EXHAUSTED": "As tentativas automáticas não resolveram todos os campos críticos.",
    "PAYMENT_DATE_NOT_DISCLOSED": "A data de pagamento ainda não foi divulgada pelo emissor.",
    "REFERENCE_NOT_FOUND": "O ativo não foi confirmado na base oficial.",
    "REFERENCE_IDENTIFIER_CONFLICT": "Os identificadores extraídos divergem da base oficial.",
    "DATE_SEQUENCE_INCONSISTENT": "A sequência de datas apresenta inconsistência.",
    "FINANCIAL_VALUES_INCONSISTENT": "Os valores financeiros não são matematicamente coerentes.",
    "EVENT_CLASSIFICATION_AMBIGUOUS": "Não foi possível identificar o tipo de evento com segurança.",
    "TITLE_BODY_CLASSIFICATION_CONFLICT": "O título e o conteúdo do aviso indicam eventos diferentes.",
    "CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD": "Um campo crítico ficou abaixo de 75% de confiança.",
    "DOCUMENT_PARTIALLY_UNREADABLE": "Parte do documento não pôde ser lida com segurança.",
    "DOCUMENT_CONFIDENCE_BELOW_THRESHOLD": "A confiança agregada do documento ficou abaixo de 75%.",
    "PDF_CORRUPT": "O PDF está corrompido ou não pôde ser aberto.",
    "OCR_FAILED": "A leitura das páginas digitalizadas falhou.",
    "LLM_PROVIDER_UNAVAILABLE": "O serviço de inteligência artificial está indisponível.",
    "LLM_STRUCTURED_OUTPUT_INVALID": "A resposta da inteligência artificial não respeitou o formato esperado.",
    "OUTPUT_WRITE_FAILED": "Não foi possível salvar o resultado.",
    "PROCESSING_FAILED": "O processamento do documento falhou.",
}
DEFAULT_REASON_LABEL = "O documento precisa de atenção."
CRITICAL_ONE = "Um campo crítico ficou abaixo de 75% de confiança."
CRITICAL_MANY = " campos críticos ficaram abaixo de 75% de confiança."

# -- admission ----------------------------------------------------------------------
ALLOWED_CONTENT_TYPES = ["application/pdf", "application/x-pdf"]
REJECT_NAME_MISSING = "A filename is required."
REJECT_NAME_PATH = "Invalid filename path."
REJECT_SUFFIX = "Only PDF files are accepted."
REJECT_CONTENT_TYPE = "File content type must be application/pdf."
REJECT_SIZE = "PDF exceeds the configured upload size limit."
REJECT_SIGNATURE = "File signature is not a PDF."
APPROVAL_NOT_FOUND = "Document not found."
APPROVAL_REFUSED = "Somente documentos em revisão podem ser aprovados manualmente."
SELECTION_NOTICE = "Somente arquivos PDF foram adicionados."

# error class of a failed document -> technical code
TECHNICAL_CODES = {
    "CORRUPT_PDF": "PDF_CORRUPT",
    "OCR": "OCR_FAILED",
    "STRUCTURED_OUTPUT": "LLM_STRUCTURED_OUTPUT_INVALID",
    "PROVIDER": "LLM_PROVIDER_UNAVAILABLE",
    "OUTPUT_WRITE": "OUTPUT_WRITE_FAILED",
}
TECHNICAL_DEFAULT = "PROCESSING_FAILED"
STATUS_LABELS = {
    "ACCEPTED": "Aceito automaticamente",
    "REVIEW_REQUIRED": "Revisão necessária",
    "PENDING_INFORMATION": "Informação pendente",
    "FAILED": "Falhou",
}
FIELD_STATUS_LABELS = {
    "EXTRACTED": "Extraído",
    "REFERENCE_ENRICHED": "Enriquecido",
    "DERIVED": "Derivado",
    "NOT_DISCLOSED": "Não divulgado",
    "NOT_APPLICABLE": "Não aplicável",
    "AMBIGUOUS": "Ambíguo",
    "CONFLICT": "Conflito",
    "UNREADABLE": "Ilegível",
    "UNKNOWN": "Desconhecido",
}
DISPOSITION_MESSAGES = {
    "PROCESSED": "Documento novo; uma execução exclusiva da pipeline foi realizada.",
    "REUSED": "Documento já processado; resultado anterior reutilizado sem nova chamada à IA.",
    "ALREADY_PROCESSING": (
        "Este conteúdo já está sendo processado por outra solicitação; "
        "nenhuma chamada duplicada à IA foi iniciada."),
    "DUPLICATE_IN_BATCH": "Documento repetido no mesmo lote; somente uma cópia foi considerada.",
    "REEVALUATED": "Documento reavaliado e nova versão adicionada ao histórico.",
}
WHY_RULE_FAILED = "Uma regra ligada a este campo foi reprovada. Confira o valor antes de utilizá-lo."
WHY_STATUS = ("A situação “", "” impede o aceite automático.")
WHY_NOT_DISCLOSED = "O próprio documento informa que o dado ainda não foi divulgado."
WHY_PENDING = "O dado está pendente e não possui evidência literal associada."
WHY_REFERENCE = "O valor veio da base oficial após a confirmação da identidade do ativo."
WHY_DERIVED = (
    "O valor foi calculado por uma regra determinística e passou pelas validações relacionadas.")
WHY_OCR = ("O valor foi encontrado por OCR; concordância entre passagens e validações resultaram em ", "%.")
WHY_DOCUMENT = ("O valor possui evidência literal e recebeu ", "% após consenso e validações.")
WHY_NONE = "Não há evidência suficiente para aumentar a confiança deste campo."
