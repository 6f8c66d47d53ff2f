"""Small word lists that pseudonyms, filler text and the default thesaurus draw from.

They are examples of our own, in no way special; callers with better lists pass theirs.
"""

FIRST_NAMES_FEMALE = ("Ada", "Beatriz", "Clara", "Dana", "Elif", "Freya", "Grace", "Hanna", "Ines", "Jana",
                      "Keiko", "Lena", "Maya", "Nora", "Olga", "Priya")
FIRST_NAMES_MALE = ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Goran", "Hugo", "Ivan", "Jonas",
                    "Kofi", "Liam", "Mateo", "Nils", "Omar", "Pavel")
LAST_NAMES = ("Adler", "Bauer", "Costa", "Dietz", "Evans", "Fischer", "Garcia", "Haas", "Ito", "Jansen",
              "Keller", "Lopez", "Meyer", "Novak", "Okafor", "Petrov", "Quinn", "Rossi", "Silva", "Tanaka",
              "Ueda", "Vogel", "Weber", "Young")
STREETS = ("Oak", "Maple", "Cedar", "Hill", "Lake", "River", "Park", "Mill", "Church", "Bridge", "Garden", "Sunset")
STREET_SUFFIXES = ("Street", "Road", "Avenue", "Lane", "Drive", "Court")
CITIES = ("Ashford", "Brookfield", "Carlton", "Dunmore", "Eastport", "Fairview", "Glenwood", "Harlow",
          "Kingsley", "Lakeside", "Milton", "Northgate")
STATES = ("Alabama", "Colorado", "Florida", "Georgia", "Illinois", "Kansas", "Michigan", "Nevada", "Ohio",
          "Oregon", "Texas", "Utah")
STATE_ABBREVIATIONS = ("AL", "CO", "FL", "GA", "IL", "KS", "MI", "NV", "OH", "OR", "TX", "UT")
COUNTRIES = ("Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Ghana", "Hungary", "India", "Japan",
             "Kenya", "Mexico")
COUNTRY_CODES = ("AT", "BR", "CA", "DK", "EG", "FR", "GH", "HU", "IN", "JP", "KE", "MX")
COMPANY_SUFFIXES = ("Inc", "LLC", "Group", "Ltd", "PLC")
MAIL_DOMAINS = ("example.com", "example.org", "example.net")
TLDS = ("com", "org", "net", "info", "biz")
JOBS = ("Accountant", "Baker", "Carpenter", "Dentist", "Editor", "Florist", "Geologist", "Historian",
        "Librarian", "Nurse", "Pilot", "Teacher")
COLORS = ("Red", "Green", "Blue", "Orange", "Purple", "Brown", "Black", "White", "Teal", "Olive")
CURRENCY_CODES = ("BRL", "CAD", "CHF", "DKK", "EUR", "GBP", "INR", "JPY", "MXN", "USD")
CURRENCY_NAMES = ("Brazilian real", "Canadian dollar", "Swiss franc", "Danish krone", "Euro", "Pound sterling",
                  "Indian rupee", "Japanese yen", "Mexican peso", "US dollar")
LANGUAGE_CODES = ("de", "en", "es", "fr", "hi", "it", "ja", "pt", "sv", "tr")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
FILE_EXTENSIONS = ("csv", "docx", "html", "json", "jpg", "mp3", "pdf", "png", "txt", "zip")
MIME_TYPES = ("application/json", "application/pdf", "audio/mpeg", "image/jpeg", "image/png", "text/csv",
              "text/html", "text/plain", "video/mp4")
HTTP_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "PATCH")
TIMEZONES = ("Africa/Cairo", "America/Chicago", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Tokyo",
             "Europe/Berlin", "Europe/London", "Pacific/Auckland")
CARD_PROVIDERS = ("Northern Card", "Union Pay Card", "Metro Card", "Globe Card")
PREFIXES_FEMALE = ("Dr.", "Mrs.", "Ms.")
PREFIXES_MALE = ("Dr.", "Mr.")
SUFFIXES = ("Jr.", "Sr.", "II", "III", "PhD", "MD")
FILLER_WORDS = ("about", "air", "answer", "between", "book", "bring", "build", "carry", "change", "city", "clear",
                "close", "color", "course", "cover", "cross", "early", "earth", "field", "figure", "final",
                "follow", "form", "friend", "garden", "group", "happen", "heavy", "hold", "house", "idea",
                "island", "keep", "kind", "language", "large", "learn", "letter", "light", "line", "listen",
                "little", "measure", "minute", "morning", "mountain", "move", "music", "never", "night", "number",
                "order", "paper", "pattern", "people", "place", "plain", "plan", "point", "quick", "reach",
                "river", "room", "round", "science", "season", "second", "sentence", "simple", "small", "sound",
                "south", "stand", "start", "state", "stone", "story", "street", "table", "teach", "travel",
                "under", "unit", "usual", "voice", "water", "window", "winter", "wonder", "world", "write", "year")
SMALL_THESAURUS = {
    "answer": ("reply", "response"),
    "begin": ("commence", "start"),
    "big": ("great", "large"),
    "build": ("construct", "make"),
    "change": ("alter", "modify"),
    "close": ("near", "shut"),
    "data": ("figures", "information"),
    "end": ("close", "finish"),
    "fast": ("quick", "rapid"),
    "find": ("discover", "locate"),
    "good": ("fine", "sound"),
    "help": ("aid", "assist"),
    "house": ("dwelling", "home"),
    "idea": ("notion", "thought"),
    "important": ("major", "significant"),
    "large": ("big", "great"),
    "make": ("create", "produce"),
    "many": ("numerous", "several"),
    "new": ("fresh", "recent"),
    "old": ("aged", "former"),
    "part": ("piece", "portion"),
    "people": ("folk", "persons"),
    "place": ("location", "spot"),
    "problem": ("difficulty", "issue"),
    "quick": ("fast", "rapid"),
    "show": ("display", "present"),
    "small": ("little", "tiny"),
    "start": ("begin", "commence"),
    "time": ("moment", "period"),
    "use": ("apply", "employ"),
    "way": ("manner", "method"),
    "work": ("labor", "toil"),
    "world": ("earth", "globe"),
    "write": ("compose", "pen"),
}
