"""Word lists, lookup tables and thresholds.

Everything here is data that results depend on. It is kept as plain text so
that a change is visible in a diff; callers may pass their own tables instead.
"""

# --- closed vocabularies -----------------------------------------------------

TRAVEL_LEDGER = "travel_ledger"
DISTRIBUTED = "distributed"
MEDIATION = "mediation"
ASSESSMENT = "assessment"
ASSESSMENT_DETAIL = "assessment_detail"
HEALTH = "health"
ATTENDEE = "attendee"
REFERENCE_LIST = "reference_list"
INVOICE_DOCUMENT = "invoice_document"
MESSAGE_ITEM = "message_item"
MESSAGE_ATTENDANCE = "message_attendance"
GENERIC = "generic"

AUTO, REVIEW, UNMATCHED = "AUTO", "REVIEW", "UNMATCHED"
UNALLOCATED = "(UNALLOCATED)"

REGISTER_TYPES = (REFERENCE_LIST, HEALTH, ATTENDEE)
DETAIL_TYPES = (ASSESSMENT_DETAIL,)
DOCUMENT_TYPES = (INVOICE_DOCUMENT, MESSAGE_ITEM, MESSAGE_ATTENDANCE)
NO_EVIDENCE_TYPES = (HEALTH, ATTENDEE, REFERENCE_LIST, ASSESSMENT_DETAIL)
LEDGER_FEED_TYPES = (HEALTH, MEDIATION, ASSESSMENT, ASSESSMENT_DETAIL, ATTENDEE)

# Feed kept when two feeds carry the same payment: smaller wins.
SOURCE_PRIORITY = {TRAVEL_LEDGER: 0, MEDIATION: 1, ASSESSMENT: 1, DISTRIBUTED: 2, GENERIC: 3}
OTHER_PRIORITY = 9

# --- thresholds --------------------------------------------------------------

AUTO_MIN = 0.90
REVIEW_MIN = 0.50
SAME_SITE_CONFIDENCE = 0.58
MANY_CONFIDENCE = 0.55
EVIDENCE_MIN = 0.85
MAX_LISTED = 10
FUZZY_MIN = 88.0
FUZZY_LEAD = 6.0
FUZZY_CAP = 0.89
FUZZY_PAIR_MIN = 80.0
PREFIX_MIN = 4
FAMILY_RARE = 8
FAMILY_CLEAR = 0.50
FAMILY_FLOOR = 0.10
ALIAS_SIMILARITY = 78.0
ALIAS_LEAD = 4.0
TICKET = "Bilet"
NAME_METHODS = ("exact_name", "subset", "prefix", "translit", "fuzzy", "alias")
GUESS_METHODS = ("subset", "translit", "prefix", "fuzzy")
CERTAIN_METHODS = ("staff_id", "national_id", "alias", "exact_name")
HOME_CITIZENSHIP = ("TURKIYE", "TURKEY", "TR", "TC", "TURK", "TURKISH")

# --- letters -----------------------------------------------------------------

# Cyrillic capitals that become more than one Latin letter.
CYRILLIC_LONG = {
    "Ж": "ZH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SCH", "Ю": "YU", "Я": "YA", "Ї": "YI",
}
# Cyrillic capitals that become one Latin letter.
CYRILLIC_ONE = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "E", "З": "Z", "И": "I",
    "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S",
    "Т": "T", "У": "U", "Ф": "F", "Х": "H", "Ы": "Y", "Э": "E", "І": "I", "Є": "E", "Ґ": "G",
    "Ә": "A", "Ө": "O", "Ұ": "U", "Ү": "U", "Қ": "K", "Ғ": "G", "Ң": "N", "Һ": "H",
}
CYRILLIC_DROPPED = "ЪЬ"
DASHES = "-‐‑‒–—―_/\\"

# --- description cleaning ----------------------------------------------------

HOTEL_WORDS = (
    "HOTEL", "OTEL", "HOSTEL", "HYATT", "SHERATON", "RADISSON", "PARK INN",
    "PLAZA", "REGENCY", "OCCIDENTAL", "RESORT", "INN", "GRAND", "HILTON",
    "MARRIOTT", "NOVOTEL", "IBIS", "RAMADA", "CROWNE", "MERCURE", "SWISSOTEL",
    "RIXOS", "WYNDHAM", "DOUBLETREE", "COURTYARD", "RENAISSANCE",
    "INTERCONTINENTAL", "KEMPINSKI", "MOVENPICK", "PULLMAN", "SOFITEL",
    "HOLIDAY", "APART", "RESIDENCE", "PALACE", "SUITES", "GUEST HOUSE",
)
NOISE_PHRASES = (
    "KONAKLAMA YURTDISI", "KONAKLAMA YURTICI", "KONAKLAMA",
    "BILET BEDELI", "BILET IADESI", "BILET IPTALI", "UCAK BILETI", "BILET",
    "RUSYA FEDERASYONU", "TURISTIK", "E VIZE", "EVIZE", "VIZE BEDELI",
    "VIZE ISLEMLERI", "VIZE",
    "EKSTRA BAGAJ UCRETI", "EKSTRA BAGAJ", "BAGAJ UCRETI", "BAGAJ",
    "TARAFINDAN TASINDI", "TARAFINDAN",
    "SARJ EDILECEK", "SARJ",
    "OTEL ISLEMLERI", "BILET ISLEM", "DIGER HIZMETLER",
    "HIZMET BEDELI", "ISLEM UCRETI", "SERVIS UCRETI", "SERVIS BEDELI",
    "REZERVASYON", "DEGISIKLIK UCRETI", "DEGISIKLIK",
    "CENAZE CELENGI", "CELENK", "DAVETIYE", "TRANSFER UCRETI",
    "IADE", "IPTAL", "FARK", "KOMISYON",
    "MR", "MRS", "MS", "MSTR", "CHD", "INF",
    "TK", "PC", "VF", "THY", "PEGASUS", "AJET", "A JET",
    "TURKISH AIRLINES", "AEROFLOT",
)
CITY_NAMES = (
    "ISTANBUL", "ANKARA", "IZMIR", "ANTALYA", "ADANA", "KAYSERI", "TRABZON",
    "MOSKOVA", "MOSCOW", "PETERSBURG", "SANKT PETERSBURG", "ST PETERSBURG",
    "MURMANSK", "NOVOSIBIRSK", "KAZAN", "SOCI", "SOCHI", "BLAGOVESHCHENSK",
    "AMUR", "USTLUGA", "UST LUGA", "HANOI", "PARIS", "LONDRA", "LONDON",
    "BERLIN", "AMSTERDAM", "DUBAI", "DOHA", "PEKIN", "SEUL", "TOKYO",
    "MILANO", "ROMA", "VIYANA", "BUDAPESTE", "BAKU", "ASTANA", "ALMATI",
)
SERVICE_WORDS = (
    "BILET", "BEDELI", "BEDEL", "UCRETI", "UCRET", "TUTARI",
    "OTEL", "HOTEL", "KONAKLAMA", "GECE", "GECELIK", "ODA",
    "VIZE", "VIZESI", "EVIZE", "KONSOLOSLUK", "ELCILIK", "BASVURU",
    "RUSYA", "FEDERASYONU", "TURISTIK", "DAVETIYE", "DAVET", "MEKTUBU",
    "TRANSFER", "HAVALIMANI", "HAVAALANI", "TERMINAL", "MERKEZ",
    "OTOBUS", "ARAC", "KIRALAMA", "KIRA", "SOFOR",
    "CENAZE", "CELENK", "CELENGI", "GONDERIMI", "GONDERIM",
    "TOPLANTI", "ORGANIZASYON", "ORGANIZASYONU", "PAKET", "PAKETI",
    "CATERING", "YEMEK", "SALON",
    "DIGER", "GIDER", "GIDERLER", "HIZMET", "HIZMETLER", "SERVIS",
    "YURT", "ICI", "DISI", "YURTICI", "YURTDISI",
    "EKSTRA", "BAGAJ", "TASINDI", "TARAFINDAN",
    "REZERVASYON", "DEGISIKLIK", "IPTAL", "IADE", "KOMISYON", "FARK",
    "SIGORTA", "ASISTAN", "ASISTANS",
    "FATURA", "EVRAK", "ADET", "TOPLAM", "SARJ", "EDILECEK",
)
# A given name that is a service word only before one of these.
CONTEXT_WORD = "IKRAM"
CONTEXT_FOLLOWERS = (
    "BEDELI", "BEDEL", "UCRETI", "UCRET", "TUTARI", "HIZMETI", "HIZMET",
    "HIZMETLERI", "GIDERI", "GIDERLERI", "SERVISI", "ORGANIZASYONU",
    "PAKETI", "CATERING",
)
GLUED_TAILS = ("TARAFINDAN", "KONAKLAMA", "TASINDI", "BEDELI", "UCRETI", "FEDERASYONU")
OPERATION_CATEGORY = {
    "bilet islem": "Bilet", "bilet islemleri": "Bilet",
    "otel islemleri": "Otel", "otel islem": "Otel",
    "vize islemleri": "Vize", "vize islem": "Vize",
    "diger hizmetler": "Diger", "transfer": "Diger",
}
CATEGORY_HINTS = (
    ("konaklama", "Otel"), ("otel", "Otel"), ("hotel", "Otel"), ("bilet", "Bilet"),
    ("ucus", "Bilet"), ("vize", "Vize"), ("bagaj", "Bagaj"), ("arabulucu", "Arabuluculuk"),
    ("saglik", "Saglik"), ("egitim", "Egitim"), ("assessment", "Egitim"), ("katilimci", "Egitim"),
)
DEFAULT_CATEGORY = "Diger"
MAX_SHARE_DENOMINATOR = 12

# --- routes ------------------------------------------------------------------

HOME_AIRPORTS = (
    "IST", "SAW", "ESB", "ADB", "AYT", "ADA", "TZX", "GZT", "KYA",
    "ASR", "DIY", "VAN", "ERZ", "MLX", "SZF", "BJV", "DLM", "NAV", "OGU",
)
SITE_AIRPORTS = (
    "LED", "VKO", "SVO", "DME", "ZIA", "BQS", "IKT", "OVB", "MMK",
    "KHV", "YKS", "CEK", "KZN", "AER", "ROV", "UFA", "SGC", "NUX",
)

# --- names -------------------------------------------------------------------

# Transliterations that stand for one sound, as pattern and plain spelling, applied in order.
SPELLING_CLASS = (
    ("X", "KS"), ("KH", "H"), ("TS", "C"), ("CH", "C"), ("SH", "S"), ("ZH", "J"), ("YU", "U"), ("YA", "A"),
    ("W", "V"), ("Q", "K"), ("PH", "F"), ("OU", "U"), (r"\bGE", "GO"), ("EY", "EI"), ("EE|II|IY|YI", "I"),
    ("YR", "IR"), (r"\bY", "I"), (r"(?<=[A-Z])([A-Z])\1\b", "$1"),
)

# Feminine surname endings and their masculine form; longer endings first.
FEMININE_ENDINGS = (
    ("OVSKAYA", "OVSKIY"), ("EVSKAYA", "EVSKIY"), ("SKAYA", "SKIY"), ("TSKAYA", "TSKIY"),
    ("CKAYA", "CKIY"), ("OVA", "OV"), ("EVA", "EV"), ("YOVA", "YOV"), ("INA", "IN"),
    ("YNA", "YN"), ("AYA", "IY"),
)
FEMININE_MIN = 6

# --- companies and sites -----------------------------------------------------

ENTITY_LABELS = (
    "RHI", "RHI RUSSIA", "UST LUGA", "USTLUGA", "RENSERVIS", "RENSTROYDETAL", "RSD", "RS",
    "RC PETER", "RC PETERSBURG", "RC MOSKOVA", "RC MOSCOW", "ONE TOWER", "TOP TOWER",
    "SAREN", "KRONDEX", "YAKA LLC", "YAKA", "RSS", "BSK", "BSA", "ULTK", "RC",
)
CANONICAL_COMPANY = {
    "RENSTROYDETAL": "RSS", "RENSERVIS": "RSS", "RSD": "RSS", "RS": "RSS", "RSS": "RSS",
    "RC PETER": "RC", "RC PETERSBURG": "RC", "RC MOSKOVA": "RC", "RC MOSCOW": "RC",
    "ONE TOWER": "RC", "TOP TOWER": "RC", "RC": "RC",
    "UST LUGA": "UST LUGA", "USTLUGA": "UST LUGA", "ULTK": "UST LUGA",
    "RHI": "RHI", "RHI RUSSIA": "RHI",
    "BSK": "BSK", "BSK MANAGEMENT": "BSK", "BSK MANAGEMENT GROUP": "BSK",
    "BSA": "BSA", "SAREN": "SAREN", "KRONDEX": "KRONDEX", "YAKA LLC": "YAKA LLC", "YAKA": "YAKA LLC",
}
POOL_COMPANY = {
    "rhi": "RHI", "rc": "RC", "rc peter": "RC", "rc moskova": "RC",
    "rsd": "RSD", "renstroydetal": "RSD", "renservis": "RSS", "rs": "RSS", "rss": "RSS",
}
SITE_SYNONYMS = {
    "GPP PROJE": "GPP Project",
    "GPP PROJESI": "GPP Project",
    "UST LUGA GPP": "GPP Project",
    "UST LUGA GPP PROJESI": "GPP Project",
    "UST LUGA GAS PROCESSING COMPLEX GPP": "GPP Project",
    "UST LUGA GAS PROCESSING COMPLEX GPC": "GPP Project",
    "UST LUGA GAS PROCESSING COMPLEX": "GPP Project",
    "AMURSKI GAZ ISLETME FABRIKASI": "Amursky Gas Processing Plant",
    "AMURSKIY GAZ ISLETME FABRIKASI": "Amursky Gas Processing Plant",
    "CATERING AMURSKY GAS PROCESSING PLANT": "Amursky Gas Processing Plant",
    "AMUR": "Amursky Gas Processing Plant",
    "AMURSKY": "Amursky Gas Processing Plant",
    "AMUR GPZ": "Amursky Gas Processing Plant",
    "AMUR AGPP": "Amursky Gas Processing Plant",
    "AGPZ": "Amursky Gas Processing Plant",
    "UDOKAN GMK": "Udokan (GMK)",
    "UDOKAN": "Udokan (GMK)",
    "GYDAN": "ALNG2-Gydan",
    "ALNG2 GYDAN": "ALNG2-Gydan",
    "ALNG2 GBS": "ALNG2-GBS Project",
    "MOSKOVA": "RHI Russia - Headquarter (Moscow)",
    "MOSCOW": "RHI Russia - Headquarter (Moscow)",
    "MOSKOVA OFIS": "RHI Russia - Headquarter (Moscow)",
    "HEADQUARTER": "RHI Russia - Headquarter (Moscow)",
    "UST LUGA ST PETERSBURG OFFICE": "Ust-Luga – Reshetnikova Office",
    "ST PETERSBURG OFFICE": "Ust-Luga – Reshetnikova Office",
    "RESHETNIKOVA": "Ust-Luga – Reshetnikova Office",
}
TRUE_MARKS = ("E", "EVET", "1", "TRUE", "T", "YES", "Y", "AKTIF", "X")

# --- cells -------------------------------------------------------------------

BLANK_MARKS = ("", "nan", "nat", "none", "null", "-", "#n/a", "na")
HEADER_ROWS = 15
SHORT_SYNONYM = 3
SHORT_SUFFIXES = ("", "u", "i", "su", "si", "nu", "ni", "lari", "leri")
SHORT_EXCLUSIONS = {
    "kod": ("proje", "posta", "masraf", "ulke", "para birimi", "doviz", "vergi", "hesap", "urun",
            "firma", "sirket", "departman", "tedarikci", "musteri", "birim", "is kod", "gider",
            "hizmet", "santiye", "kod adi", "banka", "iban", "swift"),
    "id": ("invoice", "fatura", "belge", "kayit", "transaction", "islem", "order", "siparis",
           "booking", "document", "record", "ticket", "bilet", "payment", "odeme", "batch"),
    "no": ("invoice", "fatura", "belge", "evrak", "kayit", "islem", "order", "siparis", "ticket",
           "bilet", "batch", "sira", "s no", "telefon", "phone", "hesap", "iban", "pasaport",
           "passport", "police", "policy", "seri", "oda", "room", "ucus", "flight"),
    "tc": ("batch", "etc"),
}
FIELD_SYNONYMS = {
    "person": ("ad soyad", "adi soyadi", "ad ve soyad", "isim soyisim", "isim", "personel adi",
               "personel", "katilimci", "calisan", "yolcu", "full name", "name", "aciklama"),
    "staff_id": ("sicil", "sicil no", "personel no", "personel numarasi", "id", "employee id",
                 "tabel", "kod"),
    "national_id": ("tckn", "tc kimlik no", "tc kimlik", "personel t c", "t c kimlik",
                    "kimlik no", "tc no", "tc"),
    "amount": ("tutar", "satis", "borc", "amount", "toplam", "bedel", "fiyat", "energo payi",
               "usd", "total", "hizmet ucreti", "servis ucreti", "islem ucreti",
               "arabulucu ucreti", "arabuluculuk ucreti", "danismanlik ucreti", "egitim ucreti",
               "vize ucreti", "bagaj ucreti", "konaklama ucreti", "ucreti"),
    "doc_date": ("belge tarihi", "fatura tarihi", "islem tarihi", "kayit tarihi", "tarih", "date"),
    "site_label": ("santiye", "santiyesi", "proje", "masraf merkezi", "masraf yeri", "gorev yeri",
                   "cost center", "yansitma", "ilgili sirket", "sirket"),
    "currency": ("para birimi", "doviz", "doviz cinsi", "currency", "ccy", "cur", "pb", "валюта"),
}
FIELD_EXCLUSIONS = {
    "person": ("company name", "firma adi", "sirket adi", "hotel name", "otel adi", "proje adi",
               "project name", "dosya adi", "file name", "bank name", "banka adi"),
    "staff_id": ("proje kodu", "proje kod", "posta kodu", "masraf merkezi kod", "masraf yeri kod",
                 "ulke kodu", "para birimi kod", "doviz kod", "vergi kod", "hesap kod",
                 "urun kodu", "firma kod", "sirket kod", "departman kod", "tedarikci kod",
                 "musteri kod", "birim kod", "is kodu", "gider kod", "masraf kod", "hizmet kod",
                 "santiye kod", "kod adi", "project code", "postal code", "zip code",
                 "cost center code", "cost centre code", "currency code", "country code",
                 "tax code", "account code", "product code", "vendor code", "customer code",
                 "service code", "invoice id", "invoice no", "fatura id", "fatura no",
                 "belge id", "belge no", "kayit id", "kayit no", "transaction id", "islem id",
                 "islem no", "order id", "siparis id", "siparis no", "booking id",
                 "document id", "document no", "record id", "ticket no", "bilet no", "pnr",
                 "batch"),
    "amount": ("brut ucret", "net ucret", "aylik ucret", "gunluk ucret", "saat ucreti",
               "saatlik ucret", "maas", "salary", "wage", "ucret skalasi", "baz ucret",
               "temel ucret", "asgari ucret"),
    "doc_date": ("dogum tarihi", "dogum"),
}
ID_SHARE = 0.6
REPEAT_SHARE = 0.8
REPEAT_MIN = 10
REGISTER_ROWS = 200
PIVOT_MARKS = (
    "count of", "sum of", "average of", "min of", "max of", "row labels", "column labels",
    "satir etiketleri", "sutun etiketleri", "nazvaniya strok", "nazvaniya stolbtsov",
    "kolichestvo po polyu", "summa po polyu",
)
PIVOT_HEADERS = ("grand total", "genel toplam", "obschiy itog", "toplam", "total")
TOTAL_LABELS = (
    "toplam", "genel toplam", "ara toplam", "odenecek", "odenecek tutar", "iade", "total",
    "grand total", "sub total", "subtotal", "satir etiketleri", "ozet", "genel",
    "toplam tutar", "net toplam", "kdv", "kdv dahil", "kdv haric",
)
TOTAL_PREFIXES = ("genel toplam", "ara toplam", "grand total")
TOTAL_TAILS = (
    "usd", "eur", "rub", "try", "tl", "tutar", "amount", "sum", "kdv", "dahil", "haric",
    "net", "brut", "genel", "ara", "bakiye", "borc", "alacak", "fatura", "invoice",
)
CURRENCY_WORDS = {
    "usd": "USD", "$": "USD", "dolar": "USD", "eur": "EUR", "euro": "EUR", "€": "EUR",
    "rub": "RUB", "rur": "RUB", "ruble": "RUB", "руб": "RUB", "try": "TRY", "tl": "TRY",
    "₺": "TRY", "gbp": "GBP", "kzt": "KZT", "cny": "CNY",
}
PERSONAL_HEADER = (
    "tc", "t c", "tckn", "tcno", "kimlik", "dogum", "tel", "telefon", "phone", "gsm", "cep",
    "mobile", "pasaport", "passport", "iban", "adres", "address", "e posta", "eposta", "email",
    "e mail", "mail",
)

# Ordered rules over header text: (type, texts that must all appear in one of the groups).
FEED_RULES = (
    (TRAVEL_LEDGER, (("cari hareket",),)),
    (DISTRIBUTED, (("santiyesi", "ucus guzergahi"), ("ucus guzergahi", "ucus bilgisi"))),
    (ASSESSMENT, (("katilimci", "paket"), ("katilimci", "energo payi"), ("katilimci", "uygulama turu"))),
    (MEDIATION, (("arabulucu",),)),
    (HEALTH, (("bordrolu liste",), ("bordrosuz liste",), ("tckn", "saglik kontrol"))),
    (ATTENDEE, (("=id", "alt fonksiyon"),)),
    (REFERENCE_LIST, (("sicil no", "masraf merkezi", "!amount"),)),
    (GENERIC, ((),)),
)

# --- message text ------------------------------------------------------------

MONEY_MARKS = {
    "$": "USD", "usd": "USD", "us$": "USD", "₺": "TRY", "tl": "TRY", "try": "TRY", "trl": "TRY",
    "€": "EUR", "eur": "EUR", "₽": "RUB", "rub": "RUB", "руб": "RUB", "руб.": "RUB",
}
MESSAGE_TOTALS = ("toplam", "total", "itogo", "genel toplam", "grand total", "sum")

# --- map suggestions ---------------------------------------------------------

CODE_FILLERS = (
    "PROJECT", "PROJESI", "PROJE", "THE", "AND", "VE", "OF", "FOR",
    "SERVICES", "SERVICE", "OOO", "LLC", "AS",
)
CODE_SHORT = {
    "MANAGEMENT": "MGMT", "BUSINESS": "BUS", "CENTER": "CTR", "CENTRE": "CTR",
    "PRODUCTION": "PROD", "RENSTROYDETAL": "RSD", "RENSERVIS": "RSS",
    "CATERING": "CATER", "MURMANSK": "MRM", "NOVOSIBIRSK": "NSK",
    "HEADQUARTER": "HQ", "TECHNICAL": "TECH", "OFFICE": "OFC",
}
CODE_FALLBACK = "MERKEZ"

# --- accuracy readings -------------------------------------------------------

DEFAULT_LABEL = "RHI"
OUT_OF_SCOPE_LABELS = (
    "RENSERVIS", "RENSTROYDETAL", "RSD", "RC PETER", "RC PETERSBURG", "RC MOSKOVA",
    "RC MOSCOW", "ONE TOWER", "TOP TOWER", "SAREN", "YAKA", "YAKA LLC",
)
CODE_LABELS = {
    "GPP": ("UST LUGA GPP", "UST LUGA", "GPP"),
    "AGPP": ("AMUR", "AMURSKY", "AGPZ"),
}
COMPANY_LABELS = {
    "RHI": ("RHI", "RHI RUSSIA"),
    "UST LUGA": ("UST LUGA", "UST LUGA GPP", "USTLUGA"),
}
