"""Fixed values of the review taxonomy: word lists, codes and patterns.

Everything in this module is data.  Keywords are written the way they look
after accent folding (see ``functions.text.normalize``).
"""

# --- fixed values: quality filter -------------------------------------------

PLACEHOLDER_TEXTS = ("(sans commentaire)", "sans commentaire", "n/a", "na", "...")

GENERIC_PHRASES = (
    "ok", "bien", "bof", "nul", "rien à dire", "rien a dire", "cool", "super",
    "top", "génial", "genial", "parfait", "good", "great", "fine", "nothing",
)

MIN_CHARS = 5
MIN_WORDS = 2
MIN_LETTERS = 3

REASON_EMPTY = "vide"
REASON_PLACEHOLDER = "placeholder"
REASON_TOO_SHORT = "trop_court"
REASON_NO_TEXT = "non_textuel"
REASON_GENERIC = "generique_non_actionnable"

EMPTY_BODY_TEXT = "(sans commentaire)"

# --- fixed values: categories, in tie-break order ---------------------------

NEGATION_PATTERN = (
    r"(?:pas|plus|jamais|aucun|aucune|ni|not|no)\s+(?:du\s+tout\s+|d'|une?\s+|de\s+|a\s+)?"
    r"(?:arnaque|escroc|escroquerie|fraude|scam|voleur|bug|beug"
    r"|complique|complexe|confus|confusing|difficile|difficult|complicated)"
)

CATEGORY_KEYWORDS = {
    "app_fr": (
        "francais", "anglais", "allemand", "langue", "traduction", "traduire",
        "dollars", "devise", "$", "currency", "vrbo", "indicatif",
    ),
    "fiabilite_reservations": (
        "annule", "annulee", "annulation", "annuler", "indisponible",
        "derniere minute", "non garanti", "non confirme", "pas disponible",
        "calendrier", "disponibilite", "check-in", "check-out", "double reservation",
    ),
    "transparence_financiere": (
        "caution", "remboursement", "rembourse", "refund", "paiement", "payment",
        "frais", "facture", "prix", "tarif", "argent", "carte bancaire",
        "prelevement", "depot", "arnaque", "scam", "escroquerie", "voleur",
        "commission", "surfacturation", "supplement", "acompte",
    ),
    "parcours_paiement": (
        "paiement refuse", "carte refusee", "transaction echouee",
        "double prelevement", "preauthorisation", "preautorisation", "3d secure",
        "stripe", "paypal",
    ),
    "service_client": (
        "service client", "customer service", "sav", "support", "assistance",
        "conseiller", "joindre", "injoignable", "aucune reponse", "reclamation",
        "interlocuteur", "tchat", "hotline", "chatbot",
    ),
    "qualite_annonces": (
        "annonce", "photo", "description", "non conforme", "trompeuse",
        "fausse annonce", "annonce indisponible",
    ),
    "communication_hote": (
        "hote", "proprietaire", "reponse hote", "hote ne repond", "communication",
        "message", "contact hote", "contact proprietaire",
    ),
}

UNCLASSIFIED = "non_classe"

# --- fixed values: severity and persona -------------------------------------

SEVERITY_KEYWORDS = (
    "arnaque", "escroquerie", "escroc", "fraude", "scandale", "honte", "honteux",
    "tribunal", "justice", "avocat", "plainte", "illegal", "voleur",
    "inadmissible", "inacceptable", "danger", "dangereux", "insalubre",
)

# Rating 2 in one of these categories counts as high severity.
ESCALATED_CATEGORIES = (
    "transparence_financiere", "fiabilite_reservations", "parcours_paiement",
)

OWNER_PATTERNS = (
    "je suis proprietaire", "je suis hote", "en tant qu'hote",
    "en tant que proprietaire", "mon annonce", "mes annonces", "mon bien",
    "mes biens", "mes voyageurs", "mes locataires", "espace proprietaire",
    "espace hote", "publier mon annonce", "publier une annonce",
    "gerer mes reservations",
)

# --- fixed values: second-pass model ----------------------------------------

MODEL_CATEGORIES = {
    "app_fr": "Localisation / langue / devise (français manquant, dollars, traduction)",
    "transparence_financiere": "Frais cachés, caution, remboursement, arnaque, opacité tarifaire",
    "fiabilite_reservations": (
        "Annulation, indisponibilité de dernière minute, calendrier, double résa"
    ),
    "service_client": "SAV injoignable, support absent, aucune réponse, hotline, chatbot",
    "qualite_annonces": "Photos / description trompeuse, annonce non conforme",
    "parcours_paiement": "Échec de paiement, double prélèvement, 3D Secure, carte refusée",
    "communication_hote": "Hôte/propriétaire qui ne répond pas, messagerie, échange",
    "non_classe": "Aucune catégorie ne s'applique clairement",
}

PROMPT_HEAD = (
    "Tu es un classifieur d'avis utilisateurs (apps Abritel/Airbnb/Booking).\n\n"
    "Réponds UNIQUEMENT par un objet JSON strict de cette forme :\n"
    '{"category": "<code>", "confidence": <float entre 0 et 1>}\n\n'
    "Les codes valides et leur signification :\n"
)
PROMPT_BEFORE_TEXT = '\n\nAvis à classer :\n"""'
PROMPT_AFTER_TEXT = '"""\n\nJSON :'

DEFAULT_CONFIDENCE = 0.5
SOURCE_KEYWORDS = "heuristic"
SOURCE_MODEL = "llm"

# --- fixed values: routing, marts and limits --------------------------------

OWNER_TEAMS = {
    "transparence_financiere": "finance",
    "parcours_paiement": "finance",
    "service_client": "sav",
    "fiabilite_reservations": "sav",
    "app_fr": "produit",
    "qualite_annonces": "trust_safety",
    "communication_hote": "sav",
}
DEFAULT_OWNER_TEAM = "sav"

DISPUTE_CATEGORIES = ("transparence_financiere", "parcours_paiement")

EXCERPT_CHARS = 280
PAYLOAD_EXCERPT_CHARS = 1900

ALERT_MIN_HIGH = 5
ALERT_MIN_RATIO = 2
ALERT_WEEKS = 5

WINDOW_DAYS = 30
MAX_PER_SOURCE_BRAND = 100
