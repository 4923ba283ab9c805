"""Fixed values the results depend on: word lists, weights, store names, markers.

Everything here is data. Order matters in the keyword lists: the first match wins.
"""

from __future__ import annotations

# --- fixed values: stores -------------------------------------------------
# store key -> (display name, marker)
STORES = {
    "amazon": ("Amazon", "\U0001f4e6"),
    "kabum": ("KaBuM!", "\U0001f5a5"),
    "aliexpress": ("AliExpress", "\U0001f30f"),
    "shopee": ("Shopee", "\U0001f6cd"),
    "pelando": ("Pelando", "\U0001f525"),
    "promobit": ("Promobit", "⚡"),
    "terabyte": ("Terabyte Shop", "\U0001f4bb"),
    "mercadolivre": ("Mercado Livre", "\U0001f6d2"),
    "unknown": ("Loja", "\U0001f3ea"),
}
DEFAULT_MARKER = "\U0001f3ea"
AGGREGATORS = ("pelando", "promobit")
# sources that can be collected, in their default order
SOURCES = (
    "shopee", "aliexpress", "amazon", "pelando",
    "promobit", "kabum", "terabyte", "mercadolivre",
)

# --- fixed values: origin store name pattern -> marker, first match wins ---
ORIGIN_MARKERS = (
    ("amazon", "\U0001f4e6"), ("kabum", "\U0001f5a5"), ("aliexpress", "\U0001f30f"),
    ("shopee", "\U0001f6cd"), ("mercado livre", "\U0001f6d2"), ("mercadolivre", "\U0001f6d2"),
    ("terabyte", "\U0001f4bb"), ("magazine luiza", "\U0001f4d8"), ("magalu", "\U0001f4d8"),
    ("americanas", "\U0001f534"), ("casas bahia", "\U0001f3e0"), ("ponto frio", "❄"),
    ("extra", "⭐"), ("carrefour", "\U0001f6d2"), ("submarino", "\U0001f6a2"),
    ("c&a", "\U0001f455"), ("renner", "\U0001f457"), ("hering", "\U0001f455"),
    ("pague menos", "\U0001f48a"), ("netshoes", "\U0001f45f"), ("centauro", "\U0001f3c3"),
)

# --- fixed values: scoring ------------------------------------------------
# keyword -> weight, first match wins, the weight counts twice
VALUE_KEYWORDS = (
    ("notebook", 10), ("laptop", 10), ("macbook", 10), ("rtx", 10), ("gpu", 10),
    ("iphone", 10), ("galaxy s", 9), ("smartphone", 8), ("ssd", 8), ("nvme", 8),
    ("processador", 9), ("ryzen", 9), ("intel core", 9), ("placa de vídeo", 10),
    ("monitor", 8), ("smart tv", 9), ("oled", 10), ("qled", 9),
    ("playstation", 10), ("ps5", 10), ("xbox", 10), ("nintendo switch", 10),
    ("console", 9), ("controle", 7), ("headset", 6),
    ("air fryer", 7), ("airfryer", 7), ("robô aspirador", 8), ("robo aspirador", 8),
    ("máquina de lavar", 8), ("geladeira", 8), ("ar condicionado", 8),
)
LOW_VALUE_KEYWORDS = (
    "capinha", "película", "adesivo", "cabo usb", "chaveiro", "meia",
    "cueca", "calcinha", "escova de dente", "sabonete", "shampoo",
    "detergente", "esponja", "pano de prato", "caneta", "lápis",
)
# price above the bound -> points, highest bound first; below CHEAP_PRICE -> penalty
PRICE_BANDS = ((2000, 40), (1000, 35), (500, 25), (100, 15))
CHEAP_PRICE, CHEAP_PENALTY = 10, -20
# discount at or above the bound -> points; below WEAK_DISCOUNT -> penalty
DISCOUNT_BANDS = ((50, 30), (30, 20), (15, 10))
WEAK_DISCOUNT, WEAK_PENALTY = 5, -10
LOW_VALUE_PENALTY, COUPON_POINTS, SHIPPING_POINTS = -30, 7, 3
BAD_LENGTH_PENALTY, SHOUTING_PENALTY = -15, -10
MIN_SCORE, TOP_OFFERS = 15, 10

# --- fixed values: quality gate -------------------------------------------
MIN_PRICE, MAX_PRICE, MIN_TITLE = 15.0, 50000.0, 15
BLOCKED_KEYWORDS = (
    "capinha", "película", "adesivo", "suporte celular", "cabo usb", "manual",
    "pdf", "amostra", "chaveiro", "meia", "cueca",
)
PRIORITY_KEYWORDS = (
    "ssd", "rtx", "notebook", "iphone", "airpods", "galaxy", "playstation",
    "xbox", "monitor", "gpu", "ryzen", "intel core",
)
LOW_QUALITY_WORDS = (
    "amostra grátis", "manual pdf", "etiqueta adesiva", "capinha", "película",
    "adesivo", "chaveiro", "meia", "cueca", "calcinha",
)
SPAM_PATTERNS = (
    r"teste?[\s\p{Z}]+de[\s\p{Z}]+produto", r"produto[\s\p{Z}]+indispon[ií]vel", r"fora[\s\p{Z}]+de[\s\p{Z}]+estoque",
    r"esgotado", r"ganhe dinheiro", r"renda extra", r"trabalhe em casa",
)
GENERIC_PATTERNS = (
    r"^(produto|item|oferta|promoção)[\s\p{Z}]*[0-9]*$",
    r"^[0-9\s\p{Z}.,R$]+$",
)
PLAIN_SYMBOLS = " .,/-()[]!@#$%&*+:;'\""
DIGITAL_TERMS = (
    "prime video", "temporada", "série", "series", "filme", "movie", "kindle",
    "ebook", "e-book", "digital", "aluguel", "assinatura", "unlimited",
    "music unlimited", "audible", "podcast", "episódio", "episodio", "streaming",
    "download", "edição digital", "edicao digital", "season", "volume",
    "collection", "anthology", "blu-ray", "dvd", "audiobook", "audiolivro",
)
MIN_REAL_DISCOUNT = 10.0

# --- fixed values: titles, links, duplicates ------------------------------
TITLE_STORE_NAMES = (
    "Mercado Livre", "KaBuM!", "Amazon", "Terabyte", "Pichau",
    "Magazine Luiza", "Shopee", "AliExpress", "Magalu",
)
LINK_TRACKING = r"[?&](utm_[a-zA-Z0-9_]+|ref|tag|aff_id|clickid|source|campaign|spm|scm|algo_[a-zA-Z0-9_]+)=[^&]*"
DEAL_TRACKING_NAMES = ("ref", "ref_", "tag", "aff_id", "clickid", "social_share")
DEAL_TRACKING_PREFIXES = ("utm_", "cm_sw_", "ref_=cm_")
OFFER_TRACKING_NAMES = ("ref", "tag", "aff_id", "clickid", "source")
OFFER_TRACKING_PREFIXES = ("utm_",)
SIMILARITY, RECENT_TITLES, TTL_SECONDS = 0.85, 200, 86400
RETENTION_DAYS, STATS_HOURS = 30, 24
CAPTION_LIMIT, MESSAGE_LIMIT = 1024, 4096
