"""Word lists, price bounds and constants that results depend on."""

from __future__ import annotations

# Brands, in order of precedence.
BRANDS = (
    "apple samsung xiaomi redmi poco huawei honor realme oppo vivo oneplus google nothing motorola nokia asus acer lenovo "
    "hp dell msi gigabyte lg sony philips panasonic toshiba bosch jbl anker logitech canon nikon gopro dji intel amd nvidia "
    "kingston seagate crucial tcl hisense haier beko artel"
).split()
BRAND_FAMILY = {"redmi": "xiaomi", "poco": "xiaomi"}
COMPONENT_FAMILIES = ("nvidia", "amd", "intel")
#: Product lines that name a brand where the text names none: stems to brand.
BRAND_LINES = {"apple": "iphone ipad macbook airpods apple\\s?watch".split(), "samsung": ["galaxy"]}

# Words without meaning for a match.
STOP_WORDS = (
    "the a an new buy for with and or in gb tb cheap cheapest price near nearby me closest best find looking want please "
    "around available купить новый для с и в гб тб цена недорого дешевый дешёвый дешево дёшево самый рядом поблизости "
    "ближайший лучший найти ищу хочу пожалуйста доступен"
).split()

# Spellings and their Latin form; Cyrillic letters that look like Latin ones before a digit.
SPELLINGS = {
    "айфон": "iphone",
    "айпад": "ipad",
    "макбук": "macbook",
    "самсунг": "samsung",
    "галакси": "galaxy",
    "плейстейшн": "playstation",
}
LOOKALIKES = {"а": "a", "с": "s", "м": "m"}

# Model variants; on phones those of the second list may not come unasked.
VARIANTS = "pro max ultra plus mini air fe lite slim oled fold flip se".split()
STRICT_VARIANTS = "pro max ultra plus mini fe lite fold flip se".split()

# Category, price floor and ceiling (whole tenge), stems by precedence; a stem ending in $ is a whole word.
CATEGORIES = {
    "smartphone": (
        35_000,
        2_500_000,
        r"iphone|galaxy [as]\d+|galaxy note|galaxy z |samsung [as]\d+|pixel \d|xiaomi \d+|oneplus \d+|realme \d+|vivo [vx]?\d+|"
        r"oppo (?:reno )?\d+|honor (?:magic )?\d+|motorola (?:edge )?\d+|nothing phone|redmi|poco|smartphone|phone$|смартфон|телефон",
    ),
    "laptop": (
        120_000,
        8_000_000,
        "macbook|laptop|notebook|ноутбук|thinkpad|ideapad|vivobook|zenbook|omen|victus|nitro|aspire|latitude|inspiron|pavilion|"
        "elitebook|probook",
    ),
    "tablet": (45_000, 2_500_000, "ipad|tablet|планшет|galaxy tab"),
    "tv": (60_000, 15_000_000, "телевизор|smart tv|oled|qled|tv$"),
    "headphones": (8_000, 800_000, "airpods|headphones|наушник|earbuds|galaxy buds|freebuds|гарнитур|wh-1000|quietcomfort"),
    "smartwatch": (15_000, 900_000, "apple watch|smartwatch|смарт.?час|galaxy watch|amazfit|mi band|фитнес.?браслет"),
    "monitor": (40_000, 3_500_000, "monitor|монитор"),
    "console": (90_000, 1_500_000, "playstation|ps5|ps4|xbox|nintendo|switch|консоль|приставк"),
    "camera": (70_000, 8_000_000, "фотоаппарат|dslr|mirrorless|gopro|canon eos|nikon z|sony alpha|камер"),
    "component": (
        15_000,
        4_000_000,
        r"rtx|gtx|radeon|ryzen|core i\d|ssd|nvme|видеокарт|процессор|материнск|оперативн|ddr[45]|ram$|hdd$|storage$",
    ),
    "other": (5_000, 20_000_000, ""),
}
ACCESSORY_FLOOR = 300

# Sizes of RAM that come before a slash, sizes of storage that need no unit, both in GB; the largest that
# counts; units; phone lines whose number may come before a slash; words that say what a capacity is, before and after it
# (within so many characters); categories whose titles name storage without a unit, and RAM and storage with a slash.
RAM_GB = (2, 3, 4, 6, 8, 12, 16, 18, 24, 32, 36, 40, 48, 64, 72, 96, 128, 192, 256)
STORAGE_GB = (64, 128, 256, 512, 1024, 2048)
MOST_GB = 16_384
GB, TB = ("gb", "гб"), ("tb", "тб")
NUMBERED_LINES = r"iphone|ipad|(?:google\s+)?pixel|redmi(?:\s+note)?|xiaomi|oneplus|realme|vivo|honor(?:\s+magic)?"
RAM_WORDS = ("ram|озу|оперативн[A-Za-z0-9_]*", "ram|озу|оперативн|ddr[345]")
STORAGE_WORDS = (
    r"ssd|hdd|storage|накопител[A-Za-z0-9_]*|встроен[A-Za-z0-9_]*\s+памят[A-Za-z0-9_]*",
    r"ssd|hdd|storage|накопител|встроен[A-Za-z0-9_]*\s+памят",
)
WORD_REACH = 28
UNITLESS = ("smartphone", "tablet", "laptop")
SLASHED = (*UNITLESS, "component")
MEMORY_WORDS = "ram|озу|ssd|hdd|storage"
# RAM at most where two sizes are named without a word, and where a laptop's title names one.
PLAIN_RAM_GB, LAPTOP_RAM_GB = 128, 64

# Accessories by precedence: stems in a title, stems in a request for the accessory itself.
ACCESSORIES = {
    "case": ("чехол|чехл|бампер|накладк|книжк|флип|кейс|case$", "чехол|чехл|case$|кейс|бампер|накладк"),
    "screen protector": (
        r"защитн[A-Za-z0-9_]*\s+стекл|стекло|стёкл|пленк|плёнк|бронестекл|protector",
        "стекл|стёкл|пленк|плёнк|protector|защитн",
    ),
    "cable/adapter": (
        "кабел|шнур|провод|cable|переходник|адаптер|adapter|хаб$",
        "кабел|шнур|cable|адаптер|adapter|переходник|хаб$",
    ),
    "charger": (
        "азу$|сзу$|зарядн|зарядк|charger|блок питания|power ?adapter|ac adapter|адаптер питания|power ?bank|повербанк|внешний аккумулятор",
        "зарядн|зарядк|charger|азу$|сзу$|power ?bank|повербанк",
    ),
    "holder/stand": (
        "держател|holder|подставк|крепл|штатив|tripod|mount$",
        "держател|holder|подставк|крепл|штатив|tripod",
    ),
    "strap": ("ремешок|ремешк|strap", "ремешок|ремешк|strap|браслет"),
    "bag": ("сумк|рюкзак", "сумк|рюкзак|bag$"),
    "stylus": ("стилус|stylus", "стилус|stylus"),
    "memory card": (
        "карта памяти|карты памяти|memory card|microsd|флешк|флеш.?накопит",
        "карт[A-Za-z0-9_]* памяти|memory card|microsd|флешк",
    ),
    "spare part": (
        "запчаст|дисплей в сборе|тачскрин|шлейф|аккумулятор для|батаре[A-Za-z0-9_]* для",
        "запчаст|тачскрин|шлейф|аккумулятор|дисплей",
    ),
    "sticker": ("наклейк|скин$", "наклейк|скин$"),
    "service": ("страховк|подписк|сертификат|услуг|установк|настройк", "страховк|подписк|сертификат|услуг"),
}
BUNDLED = r"в\s+комплекте|комплектуется|прилагается|included|comes?\s+with|bundled"
BUNDLED_LABELS = ("charger", "cable/adapter")

# Conditions of a listing that is no new unit: stems in a title, stems in a request for it.
CONDITIONS = {
    "used/refurbished": (
        r"б\s?/\s?у$|бу$|уценк|восстановлен|refurbish|renewed|pre[ -]?owned|second[ -]?hand|used$|витринн|open ?box",
        r"б\s?/\s?у$|уценк|восстановлен|refurbish|renewed|pre[ -]?owned|second[ -]?hand|used$|витринн|open ?box",
    ),
    "replica": (
        "копия|копи$|реплика|replica|counterfeit|fake$|copy$",
        "копия|реплика|replica|counterfeit|fake$|copy$",
    ),
}

# Travel and ranking.
EARTH_M = 6_371_000.0
DETOUR = 1.3
SPEED_KMH = 22.0
PARKING_MIN = 6.0
KZT_PER_KM = 35.0
KZT_PER_HOUR = 1_200.0
MIN_CONFIDENCE = 0.45
TOLERANCE = 0.15
DOUBT = 0.25
NO_STOCK = 0.35
CELL_DEG = 0.0005
SAME_PIN_M = 60.0
MAX_BRANCHES = 50
MAX_UNKNOWN, MAX_DOMAINS = 6, 16
SHOP_TYPES = ("electronics", "computer", "mobile_phone", "hifi", "video_games", "camera", "appliance")
MAX_GAPS = 50

# Failures that leave a gap in coverage, as a shopper reads them; "no-listings" and
# "no-match" are answers.
GAP_REASONS = {
    "blocked": "blocks automated price checks",
    "js-rendered": "shows prices only after running JavaScript",
    "no-search-endpoint": "has no readable website search",
    "timeout": "did not respond in time",
    "unreachable": "was unreachable",
    "unsafe-url": "has an invalid or non-public website address",
    "response-too-large": "returned a page too large to check safely",
}
SKIPPED_REASON = "skipped to keep the search within its time budget"
MORE_REASON = "not listed individually to keep this response compact"

# Networks of addresses that are not public.
RESERVED_V4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
RESERVED_V6 = "::/96 ::1/128 64:ff9b::/96 64:ff9b:1::/48 100::/64 2001::/32 2001:db8::/32 2002::/16 fc00::/7 fe80::/10 ff00::/8".split()
CHALLENGE = "just a moment|cf-browser-verification|challenge-platform|access denied|attention required"
# Cities that a search may start from, and the radii in metres that it offers.
CITIES = [
    ("Almaty", 43.238, 76.8829), ("Astana", 51.1282, 71.4304), ("Shymkent", 42.3417, 69.5901), ("Karaganda", 49.8047, 73.1094),
    ("Aktobe", 50.2839, 57.166), ("Taraz", 42.9, 71.3667), ("Pavlodar", 52.2873, 76.9674), ("Oskemen", 49.9483, 82.6283),
    ("Semey", 50.4111, 80.2275), ("Atyrau", 47.1167, 51.8833), ("Kostanay", 53.2144, 63.6246), ("Kyzylorda", 44.8488, 65.4823),
    ("Oral", 51.2333, 51.3667), ("Petropavl", 54.8667, 69.15), ("Aktau", 43.6532, 51.1975), ("Turkistan", 43.2973, 68.2518),
]
RADIUS_STOPS = [500, 1000, 2000, 3000, 5000, 7500, 10_000, 15_000, 25_000]
