"""Profiles: the language-dependent tables that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """Cues, lexicons and patterns of one language and chamber.

    Patterns are Java expressions; those for cues are tried in their order.
    """

    name: str
    reactions: tuple[tuple[str, str], ...]
    intensities: tuple[tuple[str, str], ...]
    weights: dict[str, float]
    government: str
    opposition: str
    house: str
    parties: tuple[tuple[str, str], ...]
    governing: dict[int, tuple[str, ...]]
    abbreviations: tuple[str, ...]
    not_a_person: str
    honorifics: str
    salutation: str
    roles: dict[str, str]
    negation_forward: tuple[str, ...]
    negation_backward: tuple[str, ...]
    proper_nouns: dict[str, tuple[str, str]] = field(default_factory=dict)
    stopwords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    digraphs: tuple[str, ...] = ()
    long_word: int = 6
    lix_bands: tuple[tuple[float, str], ...] = ((30.0, "very easy"), (40.0, "easy"), (50.0, "standard"), (60.0, "difficult"))
    default_role: str = "debate"


UPPER = "A-ZÁÉÍÓÖŐÚÜŰ"
LOWER = "a-záéíóöőúüű"

#: Fixed values of the Hungarian profile: what the note-takers' formulas mean.
HUNGARIAN = Profile(
    name="hu",
    reactions=(
        ("whistling", r"sípol|fütty|füttyög"),
        ("booing", r"pfúj|pfuj"),
        ("applause", r"\btaps|tapsol|megtapsol"),
        ("laughter", r"derülts|nevet|kacag|kuncog"),
        ("heckling", r"közbeszól|közbekiált|bekiabál|kiabál|közbevet|bekiált"),
        ("uproar", r"felzúdul|felháborod|háborg"),
        ("noise", r"\bzaj\b|\bzajong|moraj|mormog|dörömb|pisszeg"),
        ("bell", r"cseng"),
    ),
    intensities=(
        ("standing", r"felállva|állva\s+taps|feláll\w*\s+és\s+taps"),
        ("long", r"hosszan\s+tartó|hosszú|kitartó"),
        ("great", r"\bnagy\b|élénk|hatalmas|viharos|óriási|erős"),
        ("continuous", r"folyamatos|szűnni\s+nem\s+akaró"),
        ("scattered", r"szórványos|gyér|halk|néhány"),
    ),
    weights={"scattered": 0.5, "plain": 1.0, "continuous": 1.5, "great": 1.5, "long": 2.0, "standing": 3.0},
    government=r"kormánypárt|kormányzó\s+párt|kormányoldal|kormánypárti",
    opposition=r"ellenzék|ellenzéki",
    house=r"teremben\s+lévők|jelenlévők|egész\s+ház|valamennyi\s+képviselő|minden\s+oldal",
    parties=(
        ("Fidesz", r"\bFidesz\b"), ("KDNP", r"\bKDNP\b"), ("MSZP", r"\bMSZP\b"), ("Jobbik", r"\bJobbik\b"), ("LMP", r"\bLMP\b"),
        ("DK", r"\bDK\b"), ("Momentum", r"\bMomentum\b"), ("Párbeszéd", r"\bPárbeszéd\b"), ("Mi Hazánk", r"Mi\s+Hazánk"),
        ("TISZA", r"\bTISZA\b|\bTisza\b"), ("Együtt", r"\bEgyütt\b"), ("SZDSZ", r"\bSZDSZ\b"), ("MDF", r"\bMDF\b"),
    ),
    governing={39: ("Fidesz", "KDNP"), 40: ("Fidesz", "KDNP"), 41: ("Fidesz", "KDNP"), 42: ("Fidesz", "KDNP"), 43: ("TISZA",)},
    abbreviations=("dr", "id", "ifj", "özv", "stb", "ún", "pl", "ill", "kb", "sz", "vö", "min", "áll", "ny"),
    not_a_person=(
        r"közbeszól|közbekiált|bekiabál|taps|derülts|moraj|\bzaj|felzúdul|sípol|pfúj|hang\b|sorai|padsor|oldalról"
        r"|frakció|képvisel|többen|ugyanonnan|ugyanott|helyről|padsorokból|padsorokban"
    ),
    honorifics="dr|id|ifj|özv|prof",
    salutation=r"^\s*(?:(?:köszönöm|köszönjük|köszönet)[^.!?]*[.!?]\s*|tisztelt[^.!?]*[.!?]\s*)+",
    roles={
        "elhangzik az interpelláció/kérdés/azonnali kérdés": "question",
        "kérdés megválaszolva": "answer",
        "interpelláció szóban megválaszolva": "answer",
        "azonnali kérdésre adott képviselői viszonválasz": "mp_rejoinder",
        "azonnali kérdésre adott miniszteri viszonválasz": "minister_rejoinder",
        "képviselő elfogadta a választ": "reaction",
        "képviselő elutasította a választ": "reaction",
    },
    negation_forward=("nem", "sem", "se", "ne", "nincs", "nincsen", "sincs", "sincsen"),
    negation_backward=("nélkül",),
    proper_nouns={
        "Jobbik": ("Jobbik", "[/N][Nom]"), "Momentum": ("Momentum", "[/N][Nom]"),
        "Párbeszéd": ("Párbeszéd", "[/N][Nom]"), "Együtt": ("Együtt", "[/N][Nom]"),
    },
    stopwords={
        "function_words": ("a", "az", "és", "hogy", "is", "egy", "nem", "de"),
        "light_verbs": (
            "van", "volt", "lesz", "kell", "lehet", "szabad", "fog", "akar", "szeret", "kíván", "mond", "elmond", "beszél",
            "szól", "gondol", "hisz", "vél", "ért", "érez", "tud", "ismer", "lát", "néz", "említ", "jelent", "tekint",
            "kérdez", "válaszol", "köszön", "tesz", "vesz", "ad", "kap", "kér", "hoz", "visz", "jön", "megy", "áll", "tart",
            "marad", "kerül", "csinál", "hagy", "kezd", "folytat", "próbál", "történik", "benyújt", "felszólal",
        ),
        "chamber": (
            "tisztelt", "képviselőtárs", "képviselő", "honfitárs", "hölgy", "úr", "uram", "asszony", "elnök_asszony",
            "elnök_úr", "képviselő_úr", "képviselő_asszony", "szép", "köszönöm",
        ),
    },
    digraphs=("dzs", "cs", "gy", "ly", "ny", "sz", "ty", "zs"),
    long_word=8,
)

#: For prose in English, French, German and Spanish.
WESTERN = Profile(
    name="western",
    reactions=(("laughter", r"laugh|rire|lach|risa"), ("applause", r"appla|clap|beifall"), ("heckling", r"shout|interrupt|cri|ruf"), ("noise", r"noise|bruit|lärm|ruido")),
    intensities=(("long", r"long|prolong"), ("great", r"great|loud|vif|gran"), ("scattered", r"some|few|quelques|einige")),
    weights=HUNGARIAN.weights,
    government=r"government|gouvernement|regierung|gobierno",
    opposition=r"opposition|oposición",
    house=r"whole house|all sides",
    parties=(),
    governing={},
    abbreviations=("dr", "mr", "mrs", "ms", "st", "prof", "etc"),
    not_a_person=r"laugh|appla|shout|voice|member",
    honorifics="dr|mr|mrs|ms|prof",
    salutation=r"^\s*(?:(?:thank you|merci|danke|gracias)[^.!?]*[.!?]\s*)+",
    roles={"user": "question", "assistant": "answer"},
    negation_forward=("not", "no", "nicht", "kein", "ne", "pas"),
    negation_backward=("sans", "without"),
)
