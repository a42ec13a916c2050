"""Fixed values.

Word lists, patterns and thresholds that results depend on. Every operator takes a `Lexicon`,
so another catalog's lists can replace these without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
MALE_WORDS = "caballero he him hombre hombres homme king man masculina masculino men".split()
FEMALE_WORDS = "dama femenina femenino femme her mujer mujeres queen she woman women".split()
# Gender words that can be part of a name; the others only describe the audience.
NAME_GENDER_WORDS = "he her him king queen she".split()

VARIANT_WORDS = (
    "absolu absolute absolutely aqua attitude black deluxe diamonds elixir extreme gold golden intense kiss "
    "midnight night silver splendid sport stellar summer summerland supreme"
).split()

NEUTRAL_WORDS = (
    "and by colonia cologne con de del edc edp edt el en estche estuche eau for fragancia fragancias la le litro "
    "litros lt lts mini miniatura ml natural new nuevo of pack para parfum pefume perfum perfume perfumes por "
    "regalo set spray tester the toilette toillete toillette toliette unisex vap vapo vaporizador y"
).split()

SYNONYMS = {"corporal": "body", "cuerpo": "body", "hidratante": "", "locion": "lotion"}
SET_WORDS = "estche estuche pack regalo set".split()
PRODUCT_TYPE_WORDS = "body hair lotion mist splash".split()
OPTIONAL_FORMAT_WORDS = {"mist": ["body", "hair"], "splash": ["body"]}
COLLECTION_WORDS = {"etienne": ["essence"], "sabrinacarpenter": ["dream"]}
SHORT_NAME_WORDS = ["x"]
IDENTITY_NOISE_WORDS = ["s", "u"]

STORE_FILLER = (
    "estuche for fragancia new nuevo pack perfume perfumes pour s set spray vaporizador"
).split()
STORE_UNITS = "cc g gr ml".split()
NOT_FILLER_TYPOS = "parfum parfums".split()

STORE_GENDER_CODES = {
    "beautyperfumes": {"(H)": "hombre", "(M)": "mujer"},
    "dperfumes": {"(H)": "hombre", "(M)": "mujer"},
}
DECLARED_GENDER_CODES = {"female": "(M)", "male": "(H)"}
DECLARED_GENDER_TERMS = {"Femenino": "female", "Masculino": "male", "Unisex": "unisex"}

CONCENTRATION_CODES = {"EDC": "cologne", "EDP": "edp", "EDT": "edt", "PARFUM": "parfum"}
CONCENTRATION_LABELS = {
    "cologne": "EDC", "eau_fraiche": "Eau Fraîche", "edp": "EDP", "edt": "EDT", "other": "", "parfum": "Parfum",
}
# Checked in this order.
CONCENTRATION_PATTERNS = [
    (r"\b(?:eau|agua)\s+(?:de|the)\s+(?:parfum|perfume|perfum)\b", "EDP"),
    (r"\beau\s+de\s+toil+et+e\b", "EDT"),
    (r"\b(?:eau\s+de\s+cologne|agua\s+de\s+colonia)\b", "EDC"),
    (r"\bedp\b", "EDP"),
    (r"\bedt\b", "EDT"),
    (r"\bedc\b", "EDC"),
    (r"\bparfum\b", "PARFUM"),
    (r"\bcol[oó]nia\b", "EDC"),
]
VOLUME = r"(?<![\d.,])\d+(?:[.,]\d+)?\s*(?:ml|lts?|litros?|l|cc|un)\b"
EXACT_VOLUME = r"^(\d+(?:[.,]\d+)?)\s*(ml|cc|l|lts?|litros?)$"
EXACT_PRICE = r"^\$\s?(\d{1,3}(?:\.\d{3})+|\d+)$"
NODE_PRICE = r"^\$[\d.]+$"
OUT_OF_STOCK = "Sin stock online"

# Applied in this order to lower-cased text.
SPLITS = [
    (r"\bx(?=\d)", ""),
    (r"(?<=[a-z])\.(?=[a-z\d])", " "),
    (r"(?<=[a-z])(?=\d)", " "),
    (r"(?<=\d)\s*(?:ml|m)\b", " ml"),
    (r"(?:(?<=\d)|(?<=\d ml)) x(?= \d)", ""),
]
ABBREVIATIONS = [
    (r"\bariana gr\b", "ariana grande"),
    (r"\bgod wom\b", "god is a woman"),
    (r"\bmod vai\b", "mod vanilla"),
    (r"\bmod blu\b", "mod blush"),
    (r"\bmoonl\b", "moonlight"),
    (r"\bswee lik\b", "sweet like candy"),
    (r"\bthan (?=2\.0)", "thank u next "),
    (r"\bdeso\b", "desodorante"),
    (r"\bbod\b", "body"),
    (r"\bsp\b", "spray"),
    (r"\bspay\b", "spray"),
    (r"\bwom\b", "woman"),
    (r"\bw(?= edp\b)", "woman"),
    (r"\bm(?= edp\b)", "man"),
    (r"\bskr\b", "shakira"),
    (r"\bp hilton\b", "paris hilton"),
]
SET_CONTENT = [
    (r"\bb ?l\b", "body lotion"),
    (r"\bb[aá]lsamo (?=after shave\b)", ""),
]
SIZES_IN_NAME = (
    r"\d+(?:[.,]\d+)?\s*(?:ml|l|lt|lts|litros?|cc|oz|gr?)\b"
    r"|\bx\s*\d+\b|\b\d+\s*x\b|\b\d+/s\b|\b(?:edp|edt|edc|spray)\s+\d+\b"
)
NUMBER_PREFIX = r"\b(?:n\s*[°ºo]?|no|vol)\s*\.?\s*(?=\d)"
AUDIENCE_CODE = r"\((?:M|H|U)\)"
CONCENTRATION_PHRASE = (
    r"\b(?:eau\s+(?:de|du|d|the)\s+(?:parfum|perfum|toilette|cologne)|extrait\s+de\s+parfum|edp|edt|edc)\b"
)
ABBREVIATED_NAME = r"[A-Za-z]\.[A-Za-z]|[A-Za-z]{2}\d{2,}"
PLAIN_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçý'´"
PLAIN_TO = "aaaaaaeeeeiiiiooooouuuuncy"

SAME_WORD_DISTANCE = 0.35
SHORT_BRAND_KEY = 3
VARIANT_TYPO_LENGTH = 6
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Lexicon:
    """The lists one catalog's rules read."""

    male: tuple[str, ...] = tuple(MALE_WORDS)
    female: tuple[str, ...] = tuple(FEMALE_WORDS)
    name_gender: tuple[str, ...] = tuple(NAME_GENDER_WORDS)
    variants: tuple[str, ...] = tuple(VARIANT_WORDS)
    neutral: tuple[str, ...] = tuple(NEUTRAL_WORDS)
    synonyms: dict = field(default_factory=lambda: dict(SYNONYMS))
    set_words: tuple[str, ...] = tuple(SET_WORDS)
    product_types: tuple[str, ...] = tuple(PRODUCT_TYPE_WORDS)
    optional_format: dict = field(default_factory=lambda: dict(OPTIONAL_FORMAT_WORDS))
    collections: dict = field(default_factory=lambda: dict(COLLECTION_WORDS))
    short_names: tuple[str, ...] = tuple(SHORT_NAME_WORDS)
    identity_noise: tuple[str, ...] = tuple(IDENTITY_NOISE_WORDS)
    store_filler: tuple[str, ...] = tuple(STORE_FILLER)
    store_units: tuple[str, ...] = tuple(STORE_UNITS)
    not_filler_typos: tuple[str, ...] = tuple(NOT_FILLER_TYPOS)
    gender_codes: dict = field(default_factory=lambda: dict(STORE_GENDER_CODES))

    @property
    def genders(self) -> tuple[str, ...]:
        return self.male + self.female

    @property
    def audience(self) -> tuple[str, ...]:
        return tuple(w for w in self.genders if w not in self.name_gender)


DEFAULT = Lexicon()
