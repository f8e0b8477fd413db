"""Fixed values that results depend on: word lists, markers and labels."""

# Category words by purchasing power, matched as substrings.
HIGH_VALUE = (
    "klinik", "dokter", "gigi", "rumah sakit", "apotek", "laboratorium", "notaris", "pengacara", "advokat", "konsultan",
    "akuntan", "kontraktor", "arsitek", "interior", "properti", "real estate", "developer", "dealer", "showroom", "mobil",
    "hotel", "villa", "resort", "sekolah", "kampus", "universitas", "kursus", "bimbingan belajar", "catering", "wedding",
    "pernikahan", "event organizer", "percetakan", "advertising", "travel", "tour", "logistik", "ekspedisi", "asuransi", "leasing",
    "pabrik", "manufaktur", "distributor", "supplier", "bengkel resmi", "salon", "spa", "gym", "fitness", "veteriner", "hewan",
)
LOW_VALUE = ("warung", "warteg", "kaki lima", "angkringan", "warnet", "konter", "pulsa", "gerobak", "kios", "pedagang", "jajanan", "burjo")
RETAIL = (
    "toko", "butik", "fashion", "baju", "sepatu", "tas", "kosmetik", "elektronik", "furniture", "mebel", "oleh-oleh", "grosir",
    "restoran", "rumah makan", "kafe", "cafe", "bakery", "kue", "roti", "katering", "catering", "frozen", "minuman",
)

# Hosts that are not a business's own site, and free site builders.
SOCIAL_HOSTS = (
    "instagram.com", "facebook.com", "fb.com", "tiktok.com", "wa.me", "wa.link", "whatsapp.com", "linktr.ee", "lynk.id", "linkin.bio",
    "bio.link", "heylink.me", "solo.to", "campsite.bio", "twitter.com", "x.com", "youtube.com", "t.me",
)
MARKET_HOSTS = ("tokopedia.com", "shopee.co.id", "bukalapak.com", "lazada.co.id", "blibli.com", "tokopedia.link", "shopee.com")
FREE_PLATFORMS = ("Blogspot", "Wix (subdomain)", "WordPress.com", "Google Sites", "Weebly", "Webnode", "sosmed_saja", "marketplace")

# Page markers.
PIXEL_MARKS = ("googletagmanager.com", "google-analytics.com", "gtag(", "gtm.js", "connect.facebook.net", "fbq(", "fbevents.js", "clarity.ms", "analytics.tiktok.com", "hotjar.com", "ads-twitter.com")
SHOP_MARKS = ("tambah ke keranjang", "keranjang belanja", "add to cart", "checkout", "beli sekarang", "woocommerce", "snap.midtrans", "xendit", "add-to-cart", "shopping-cart", "keranjang saya")
JUNK_EMAIL = (
    "example.com", "example.org", "yourdomain", "domain.com", "email.com", "sentry.io", "wixpress.com", "@2x", ".png", ".jpg", ".jpeg", ".gif",
    ".webp", ".svg", "core-js", "polyfill", "@sentry", "godaddy.com", "namecheap", "sample@", "user@", "nama@", "info@example",
)

CLOSED = ("tutup permanen", "permanently closed", "tutup sementara", "temporarily closed")
NO_SITE = ("-", "n/a", "none")
PRICE_LOW, PRICE_HIGH = 1_000, 500_000_000
MARGIN, WIDE = 0.05, 2.0
AS_OF = "2024-01-15 00:00:00"
PLAUSIBLE = (100, 5_000_000_000)  # least and greatest middle price of a run
BLOCK_TEXT = ("just a moment", "checking your browser", "enable javascript", "verify you are human", "verifying you are human", "captcha", "akses ditolak", "access denied", "unusual traffic", "please wait while we", "ddos protection", "are you a robot", "verifikasi", "tekan dan tahan")
BLOCK_URL = ("/verify/traffic", "/verify/captcha", "/buyer/login", "/login", "captcha")
# Default fees by platform (per cent of the price, fixed sum).
FEES = {"shopee": (8.0, 5000), "tokopedia": (6.5, 5000)}

# Seed words of promotion and of brands in product titles, units and series names, and suffixes of model numbers.
PROMO = (
    "ready", "readystock", "ori", "original", "promo", "murah", "termurah", "cod", "garansi", "resmi", "bergaransi", "gratis", "ongkir", "terlaris",
    "bnib", "grosir", "diskon", "sale", "best", "seller", "free", "bonus", "limited", "stock", "stok", "siap", "kirim", "kualitas", "terjamin",
    "dijamin", "asli", "terbaik", "berkualitas", "official", "store", "shop", "toko", "jual", "baru", "new", "hot", "recommended", "terpercaya",
    "lengkap", "komplit", "amanah", "fast", "respon", "bisa", "dan", "untuk", "dengan", "yang", "atau", "the", "of", "for",
)
BRANDS = (
    "intel", "amd", "nvidia", "asus", "msi", "gigabyte", "asrock", "corsair", "kingston", "samsung", "seagate", "logitech", "razer", "steelseries",
    "hyperx", "adata", "team", "vgen", "sandisk", "crucial", "wd", "western", "digital", "cooler", "master", "deepcool", "noctua", "thermaltake", "aigo",
    "xiaomi", "lenovo", "hp", "dell", "acer", "apple", "sapphire", "powercolor", "zotac", "palit", "galax", "inno3d", "colorful", "biostar", "rexus",
    "fantech", "armaggeddon", "digital alliance", "venom", "pny", "patriot", "hiksemi", "venomrx", "transcend", "lexar", "rapoo", "tecgear", "edifier",
    "cube", "canon", "epson", "brother", "tplink", "totolink", "nzxt", "lian", "antec", "seasonic", "silverstone", "montech", "infinity",
)
UNITS = "gb|tb|mb|kb|ghz|mhz|khz|hz|w|watt|va|mm|cm|inch|inci|bit|pin|rpm|ml|kg|gr"
SERIES = "ddr|pcie|pci|usb|sata|nvme|gen|generasi|ryzen|lga|cat|pc"
SUFFIXES = "ti|super|xt|x3d|ko|kf"
# Reasons and points of a lead's need, means and reach.
SCORE_REASONS = (
    (
        ("belum punya website sendiri", 28), ("website mati/error", 28), ("platform gratisan", 12), ("listing belum diklaim", 8), ("tanpa HTTPS", 8),
        ("tidak ramah HP", 8), ("website lambat", 6), ("situs terbengkalai", 6), ("belum ada tracking iklan", 6), ("listing tanpa foto", 4),
    ),
    (
        ("rating baik", 5), ("kategori bernilai tinggi", 10), ("kategori margin tipis", -5), ("terbukti pernah belanja iklan", 5),
        ("rentang harga menengah ke atas", 5), ("punya {} lokasi", 5),
    ),
    (("nomor WhatsApp", 15), ("ada nomor telepon", 5), ("ada email", 5), ("ada akun sosmed", 3)),
)

# Provinces of each island group, regencies and cities of each metropolitan area (with the
# province where names are ambiguous), and large cities.
ISLANDS = {
    "Jawa": ("DKI Jakarta", "Jawa Barat", "Banten", "Jawa Tengah", "DI Yogyakarta", "Jawa Timur"),
    "Sumatera": ("Aceh", "Sumatera Utara", "Sumatera Barat", "Riau", "Kepulauan Riau", "Jambi", "Sumatera Selatan", "Bengkulu", "Lampung", "Kepulauan Bangka Belitung"),
    "Kalimantan": ("Kalimantan Barat", "Kalimantan Tengah", "Kalimantan Selatan", "Kalimantan Timur", "Kalimantan Utara"),
    "Sulawesi": ("Sulawesi Utara", "Sulawesi Tengah", "Sulawesi Selatan", "Sulawesi Tenggara", "Sulawesi Barat", "Gorontalo"),
    "Bali & Nusa Tenggara": ("Bali", "Nusa Tenggara Barat", "Nusa Tenggara Timur"),
    "Maluku": ("Maluku", "Maluku Utara"),
    "Papua": ("Papua", "Papua Tengah", "Papua Pegunungan", "Papua Selatan", "Papua Barat", "Papua Barat Daya"),
}
METROS = (
    ("Jabodetabek", ("Jakarta Pusat", "Jakarta Selatan", "Jakarta Barat", "Jakarta Timur", "Jakarta Utara", "Bogor", "Kabupaten Bogor", "Depok", "Tangerang", "Tangerang Selatan", "Kabupaten Tangerang", "Bekasi", "Kabupaten Bekasi"), None),
    ("Bandung Raya", ("Bandung", "Kabupaten Bandung", "Kabupaten Bandung Barat", "Cimahi", "Sumedang"), None),
    ("Gerbangkertosusila", ("Surabaya", "Gresik", "Bangkalan", "Mojokerto", "Kabupaten Mojokerto", "Sidoarjo", "Lamongan"), None),
    ("Kedungsepur", ("Semarang", "Kabupaten Semarang", "Salatiga", "Kendal", "Demak", "Grobogan"), None),
    ("Solo Raya", ("Surakarta (Solo)", "Sukoharjo", "Karanganyar", "Boyolali", "Klaten", "Sragen", "Wonogiri"), None),
    ("Kartamantul (Jogja)", ("Yogyakarta", "Sleman", "Bantul"), None),
    ("Malang Raya", ("Malang", "Kabupaten Malang", "Batu"), None),
    ("Sarbagita (Bali)", ("Denpasar", "Badung", "Gianyar", "Tabanan"), None),
    ("Mebidangro (Medan)", ("Medan", "Binjai", "Deli Serdang", "Karo"), None),
    ("Patungraya (Palembang)", ("Palembang", "Banyuasin", "Ogan Ilir"), None),
    ("Mamminasata (Makassar)", ("Makassar", "Maros", "Gowa", "Takalar"), None),
    ("Banjar Bakula", ("Banjarmasin", "Banjarbaru", "Banjar", "Barito Kuala", "Tanah Laut"), "Kalimantan Selatan"),
    ("Balikpapan-Samarinda", ("Balikpapan", "Samarinda", "Kutai Kartanegara"), None),
)
CITIES = (
    "Jakarta Pusat", "Jakarta Selatan", "Jakarta Barat", "Jakarta Timur", "Jakarta Utara", "Bandung", "Surabaya", "Medan", "Semarang", "Makassar", "Palembang",
    "Bekasi", "Depok", "Tangerang", "Tangerang Selatan", "Bogor", "Batam", "Pekanbaru", "Bandar Lampung", "Padang", "Malang", "Denpasar", "Samarinda",
    "Balikpapan", "Banjarmasin", "Yogyakarta", "Surakarta (Solo)", "Pontianak", "Manado", "Jambi", "Cimahi",
)
