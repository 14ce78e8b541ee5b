"""The default recognizers as data: entity, languages, patterns with scores, check, keywords.

Fixed values: patterns (RE2 dialect), scores, keyword lists and names must equal what users' configurations expect.
"""

from __future__ import annotations

from ..functions import checksums as C
from .registry import Recognizer

_MONTHS_EN = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
_MONTHS_ALL = r"Jan(?:uar|uary)?|Feb(?:ruar|ruary)?|M(?:är(?:z)?|ar(?:ch|zo|s)?|aggio|ag)|Apr(?:il|ile)?|May|Mai|Mayo|Jun(?:e|i|io|in|o)?|Jul(?:y|i|io|let|io)?|Aug(?:ust|usto)?|Sep(?:t(?:ember|iembre|embre)?)?|Okt(?:ober)?|Oct(?:ober|ubre|obre)?|Nov(?:ember|iembre|embre)?|Dec(?:ember|embre)?|Dez(?:ember)?|Dic(?:iembre)?|janvier|f(?:é|e)vrier|mars|avril|juin|juillet|ao(?:û|u)t|septembre|octobre|novembre|d(?:é|e)cembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
_MONTHS_DE = r"Januar|Februar|M(?:ä|ae)rz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
_AGE = r"(?:0?[1-9]|[1-9]\d|1[01]\d)"

EMAIL = r"(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}|\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b|\(\d{2,4}\)\s?\d{3,4}[-.\s]?\d{3,4}"
CREDIT_CARD = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}"
    r"|(?:2131|1800|35\d{3})\d{11}|(?:\d{4}[ \-]){3}\d{4}|(?:\d{4}[ \-]){2}\d{6}|\d{13,19})\b"
)
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IPV6 = r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|(?:[0-9a-f]{1,4}:){1,7}:|(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}|::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}"
MAC = r"(?i)\b(?:[0-9a-f]{2}[:\-]){5}[0-9a-f]{2}\b"
URL = r"(?i)\b(?:https?|ftp)://[^\s/$.?#].[^\s]*\b|\b(?:www\.)[a-zA-Z0-9\-]+(?:\.[a-zA-Z]{2,})+(?:/[^\s]*)?\b"
DATE_TIME = (
    r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?\b"
    rf"|\b{_MONTH}[/\-.]{_DAY}[/\-.]\d{{2,4}}\b|\b{_DAY}[/\-.]{_MONTH}[/\-.]\d{{4}}\b"
    rf"|\b(?:{_MONTHS_EN})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}\s+(?:{_MONTHS_EN})\s+\d{{4}}\b"
    rf"|\b(?i:{_MONTHS_ALL})[/\- ]\d{{2,4}}\b|\b\d{{1,2}}\s+(?i:{_MONTHS_ALL})\s+\d{{2,4}}\b"
    r"|\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?\b|\b(?:[01]?\d|2[0-3])h\b"
)
#: Not fixed: a superset of DATE_TIME, by the stems of its months.
_NEEDS_DATE = r"[0-9][-/.:][0-9]|[0-9]h|(?i:jan|feb|f[ée]v|m[aä]r|mag|apr|avr|abr|may|mai|jun|jui|jul|lug|giu|aug|ao[ûu]|ago|sep|set|okt|oct|ott|nov|dec|d[ée]c|dez|dic|ene|gen)(?i:[a-zäéû])*[-/\s]+[0-9]"
SSN, SSN_DOTTED, ITIN = r"\b(\d{3})[- ](\d{2})[- ](\d{4})\b", r"\b\d{3}\.\d{4}\.\d{4}\b", r"\b(9\d{2})[- ](\d{2})[- ](\d{4})\b"
US_PASSPORT, US_BANK = r"\b[A-Z]\d{8}\b", r"\b\d{8,17}\b"
US_DRIVER_LICENSE = r"\b[A-Z]\d{7}\b|\b[A-Z]{2}\d{6}\b|\b\d{9}\b"
ZIP4, ZIP5 = r"\b\d{5}-\d{4}\b", r"\b\d{5}\b"
MEDICAL_LICENSE = r"\b[A-Z]{2}-?\d{5,10}\b"
_MBI = "AC-HJKMNP-RT-Y"
HANDLE, HASHTAG = r"(?:^|[^A-Za-z0-9_])(@[ \t]?[A-Za-z][A-Za-z0-9_]{2,29})\b", r"(?:^|[^A-Za-z0-9_])(#[ \t]?[A-Za-z][A-Za-z0-9_]{2,29})\b"
DOTTED_USERNAME, STEM_USERNAME = r"\b\d{0,3}\p{Ll}{4,30}[.\-]\p{Ll}{4,30}(?:[.\-]\p{Ll}{2,30}){0,2}\d{0,4}\b", r"\b\p{Ll}{4,30}\d{2,4}\b"
_STREET_TAIL = r"[A-ZÀ-ÖØ-Þ][\p{L}\-']{1,30}(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}\-']{1,30}){0,2}(?:,?\s+\d{1,4}\s?[a-z]?)?\b"
_RO = "A-Za-zĂÂÎȘȚăâîșțŞŢşţ"
_U, _L = "[A-ZÄÖÜ]", "[a-zäöüß]"
_NAME = rf"{_U}{_L}+(?:-{_U}{_L}+)?"
_EN_KIND = r"Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|"
COUNTRIES_BIC = "DE|AT|CH|LI|LU|FR|IT|ES|PT|NL|BE|GB|IE|US|CA|DK|SE|NO|FI|IS|PL|CZ|SK|HU|RO|BG|GR|HR|SI|EE|LT|LV|CY|MT|TR|JP|CN|HK|SG|AU|NZ"
COUNTRIES_ISIN = "DE|AT|CH|LI|FR|IT|ES|PT|NL|BE|LU|GB|IE|US|CA|DK|SE|NO|FI|IS|PL|CZ|SK|HU|RO|BG|GR|HR|SI|EE|LT|LV|CY|MT|TR|JP|CN|HK|SG|AU|NZ|KR|IN|BR|MX|ZA|IL|AE|SA|KY|BM"
#: Our own: the shapes that a secrets recognizer is expected to know.
SECRET = (
    r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}\b|\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}\b"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b|(?i:\bbearer[ \t]+[A-Za-z0-9._~+/-]{20,})|\b[0-9a-f]{40}\b"
)

_STRIP = str.maketrans("", "", " -./")


def strip(s: str) -> str:
    return s.translate(_STRIP)


def strip_upper(s: str) -> str:
    return strip(s).upper()


def _vat(s: str) -> str:
    s = strip(s)
    return s[2:] if len(s) == 13 and s[:2].upper() == "IT" else s


def _p(name: str, entity: str, langs: str, *patterns: tuple[str, float], words: tuple[str, ...] = (), needs: str | None = None, **more) -> Recognizer:
    return Recognizer(name + "Recognizer", (entity,), tuple(langs.split()), patterns, keywords={entity: words} if words else {}, needs=needs, **more)


def _v(name: str, entity: str, langs: str, check, norm, *patterns: tuple[str, float], words: tuple[str, ...], **more) -> Recognizer:
    return _p(name, entity, langs, *patterns, words=words, check=check, normalize=norm, unique=True, needs=more.pop("needs", "[0-9]{2}"), **more)


GENERIC = [
    _p("Email", "EMAIL_ADDRESS", "*", (EMAIL, 1.0), words=("email", "e-mail", "mail", "address", "sender", "recipient"), needs="@"),
    _p("Phone", "PHONE_NUMBER", "*", (PHONE, 0.75), words=("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "contact", "number"), needs="[0-9]{3}|[+][0-9]"),
    _p("CreditCard", "CREDIT_CARD", "*", (CREDIT_CARD, 0.3), words=("credit", "card", "cc", "visa", "mastercard", "amex", "american express", "discover", "diners", "jcb", "payment"), needs="[0-9]{4}[ -][0-9]{4}|[0-9]{13}", check=C.luhn, normalize=lambda s: s.replace(" ", "").replace("-", ""), keep_failed=0.3),
    _p("IBAN", "IBAN_CODE", "*", (IBAN, 0.5), words=("iban", "bank", "account", "wire", "swift", "transfer", "bic"), needs="[A-Z]{2}[0-9]{2}", check=C.iban, keep_failed=0.5),
    _p("IPAddress", "IP_ADDRESS", "*", (IPV4, 0.95), (IPV6, 0.95), words=("ip", "ipv4", "ipv6", "ip address", "host", "client", "server", "remote", "addr"), needs="[0-9]\\.[0-9]|[0-9a-fA-F]:|::"),
    _p("MACAddress", "MAC_ADDRESS", "*", (MAC, 0.9), words=("mac", "mac address", "hardware address", "ethernet", "interface"), needs="[0-9a-fA-F]{2}[:-][0-9a-fA-F]{2}[:-]"),
    _p("URL", "URL", "*", (URL, 0.6), words=("url", "link", "website", "site", "domain", "endpoint"), needs="://|(?i:www\\.)"),
    Recognizer("CryptoRecognizer", ("CRYPTO",), ("*",), procedure="crypto", keywords={"CRYPTO": ("wallet", "btc", "bitcoin", "eth", "ethereum", "crypto", "address")}, needs="0x|bc1|[13][1-9a-zA-Z]{25}"),
    _p("Secret", "SECRET", "*", (SECRET, 0.9), words=("secret", "token", "key", "password", "credential", "bearer"), needs="_live_|_test_|AKIA|gh[pousr]_|xox|eyJ|(?i:bearer)|[0-9a-f]{40}"),
    _p("DateTime", "DATE_TIME", "*", (DATE_TIME, 0.85), needs=_NEEDS_DATE),
]

US = [
    Recognizer("USSocialSecurityRecognizer", ("US_SSN",), ("en",), procedure="ssn", keywords={"US_SSN": ("ssn", "social security", "social-security", "ss number", "tax id", "taxpayer")}, needs="[0-9]{3}[-. ][0-9]{2}"),
    _p("USPassport", "US_PASSPORT", "en", (US_PASSPORT, 0.5), words=("passport", "us passport", "passport number", "travel document"), needs="[A-Z][0-9]{8}"),
    _p("USBank", "US_BANK_NUMBER", "en", (US_BANK, 0.3), words=("bank", "account", "checking", "savings", "routing", "ach", "wire"), needs="[0-9]{8}", gate=60, gate_underscore=True),
    _p("USDriverLicense", "US_DRIVER_LICENSE", "en", (US_DRIVER_LICENSE, 0.6), words=("driver", "license", "licence", "dl", "driver's license", "drivers license", "dmv"), needs="[0-9]{6}"),
    _p("USITIN", "US_ITIN", "en", (ITIN, 0.85), words=("itin", "individual taxpayer", "tax id", "irs", "taxpayer identification"), needs="9[0-9]{2}[- ]", check=C.us_itin, normalize=strip, keep_score=True),
    _p("USZip", "POSTAL_CODE", "en", (ZIP4, 0.85), (ZIP5, 0.55), words=("zip", "zip code", "postal code", "postal-code", "address", "street", "ave", "avenue", "boulevard", "blvd", "mailing", "shipping", "billing"), needs="[0-9]{5}"),
    _p("MedicalLicense", "MEDICAL_LICENSE", "en", (MEDICAL_LICENSE, 0.5), words=("medical", "license", "licence", "physician", "doctor", "dea", "npi", "practitioner"), needs="[A-Z]{2}-?[0-9]{5}"),
    _v("USNPI", "US_NPI", "en", C.us_npi, strip, (r"\b\d{10}\b", 0.3), words=("npi", "national provider identifier", "provider id", "provider number"), gate=48, needs="[0-9]{10}"),
    _v("USDEA", "US_DEA", "en", C.us_dea, None, (r"\b[A-Z][A-Z9]\d{7}\b", 0.4), words=("dea", "dea number", "dea registration", "prescriber", "controlled substance"), needs="[A-Z9][0-9]{7}"),
    _v("USMBI", "US_MBI", "en", C.us_mbi, strip, (rf"\b[1-9][{_MBI}][0-9{_MBI}]\d-?[{_MBI}][0-9{_MBI}]\d-?[{_MBI}][{_MBI}]\d\d\b", 0.6), words=("mbi", "medicare", "medicare beneficiary", "medicare number"), needs="[A-Z]{2}[0-9]{2}"),
    Recognizer("ENAnomalyRecognizer", ("PERSON",), ("en",), procedure="en_names", keywords={"PERSON": (
        "patient", "patients", "doctor", "doctors", "physician", "physicians", "nurse", "nurses", "surgeon", "surgeons", "clinician", "provider", "caregiver", "therapist", "psychiatrist", "consultant",
        "admitted", "discharged", "diagnosed", "treated", "examined", "assessed", "prescribed", "referred", "seen", "reviewed", "consulted", "evaluated", "presented", "complained",
        "name", "named", "born", "dob", "mrn", "id", "patientid", "mr", "mrs", "ms", "dr", "prof", "called", "spoke", "wrote", "phoned", "contacted", "visited")}),
    Recognizer("ENOrganizationRecognizer", ("ORGANIZATION",), ("en",), procedure="en_organizations", needs="Hospi|[Cc]linic|Medical|Health|General|Memorial|Infirmary|Sana?t|Sanit|Hopkins|Sinai|Kaiser|Presbyterian|NYU|UCSF|UCLA|Stanford|Brigham|Houston|Karolinska|Guy's"),
    _p("ENStreet", "STREET_ADDRESS", "en",
       (r"\b\d{1,5}[,\s]+(?:[NSEW]{1,2}\s+)?[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+(?:" + _EN_KIND + r"Court|Ct\.?|Place|Pl\.?|Way|Spur|Trail|Pike|Highway|Hwy\.?|Circle|Cir\.?|Plaza|Plz\.?|Terrace|Ter\.?|Parkway|Pkwy\.?|Square|Sq\.?|Crescent|Cres\.?|Mews|Row|Walk|Close|Gardens|Heights|Park)\b", 0.85),
       (r"\b[NSEW]{1,2}\s+\d{1,3}(?:st|nd|rd|th)\s+(?:" + _EN_KIND + r"Place|Pl\.?|Way)\b", 0.88),
       (r"\b[NSEW]{1,2}\s+[A-Z][A-Za-z]{3,30}(?:\s+[A-Z][A-Za-z]{3,30})?\b", 0.72),
       (r"\b(?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Room|Rm\.?|Bldg\.?|Building|Floor|Fl\.?)\s+[A-Z0-9][A-Z0-9-]{0,8}\b", 0.85),
       words=("address", "street", "ave", "avenue", "boulevard", "residence", "mailing", "shipping", "billing", "home", "office"), needs=r"[0-9]|\b[NSEW]{1,2}\s|Apt|Apartment|S(?:ui)?te|Unit|R(?:oo)?m|B(?:uilding|ldg)|Fl"),
    _p("ENPerson", "PERSON", "en", (r"\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sir|Madam|Lord|Lady|Hon|Rev|Capt|Lt|Sgt|Col|Gen|Adm)\.", 0.82), (r"\b[A-Z][a-z]{2,30}_[A-Z][a-z]{2,30}\d{0,4}\b", 0.85), (r"\b[A-Z][a-z]{4,30}\d{1,4}\b", 0.72), words=("name", "patient", "customer", "doctor", "contact", "user", "username", "account"), no_structural=True, needs=r"[a-z][0-9]|[a-z]_[A-Z]|(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sir|Madam|Lord|Lady|Hon|Rev|Capt|Lt|Sgt|Col|Gen|Adm)\."),
]

SHARED = [
    Recognizer("SocialHandleRecognizer", ("PERSON", "ORGANIZATION"), ("*",), ((HANDLE, 0.85, "PERSON"), (HASHTAG, 0.78, "ORGANIZATION")), group=1, needs="[@#]"),
    _p("Username", "PERSON", "*", (DOTTED_USERNAME, 0.5), (STEM_USERNAME, 0.5), needs=r"[^\s0-9.\-]{4}[.\-][^\s0-9.\-]{4}|[^\s0-9]{4}[0-9]{2}"),
    _p("FRStreet", "STREET_ADDRESS", "*", (r"\b(?:Rue|Avenue|Av\.|Boulevard|Bd\.|Bvd\.|Place|Pl\.|Allée|Allee|Impasse|Cours|Quai|Chemin|Route|Rte\.|Voie|Square|Sq\.)\s+(?:de\s+la\s+|du\s+|de\s+|des\s+|le\s+|la\s+|les\s+|l['’])?" + _STREET_TAIL, 0.8), needs=r"(?:Rue|Av(?:enue|\.)|Boulevard|Bv?d\.|Pl(?:ace|\.)|All[ée]e|Impasse|Cours|Quai|Chemin|R(?:oute|te\.)|Voie|Sq(?:uare|\.))\s"),
    _p("ITStreet", "STREET_ADDRESS", "*", (r"\b(?:Via|Viale|V\.le|Piazza|P\.zza|Corso|C\.so|Largo|Vicolo|Strada|Str\.|Piazzale|P\.le|Lungomare|Calle|Salita|Discesa)\s+(?:dei\s+|delle\s+|della\s+|del\s+|dello\s+|degli\s+|delle\s+|di\s+|San\s+|Santa\s+|Sant['’])?" + _STREET_TAIL, 0.8), needs=r"(?:Via(?:le)?|V\.le|Piazza(?:le)?|P\.(?:zza|le)|Corso|C\.so|Calle|Largo|Vicolo|Str(?:ada|\.)|Lungomare|Salita|Discesa)\s"),
    _p("ESStreet", "STREET_ADDRESS", "*", (r"\b(?:Calle|C\/|Avenida|Av\.|Avda\.|Plaza|Pl\.|Paseo|Pso\.|Camino|Carrera|Cra\.|Carretera|Ctra\.|Ronda|Travesía|Travesia|Glorieta|Ruta)\s+(?:de\s+la\s+|de\s+los\s+|de\s+las\s+|del\s+|de\s+|la\s+|el\s+|los\s+|las\s+)?" + _STREET_TAIL, 0.8), needs=r"(?:C(?:alle|/|amino|arrera|arretera|t?ra\.)|Av(?:enida|d?a?\.)|Pl(?:aza|\.)|P(?:aseo|so\.)|Ronda|Traves[íi]a|Glorieta|Ruta)\s"),
]

REGIONAL = [
    _v("UKNHS", "UK_NHS", "en", C.uk_nhs, strip, (r"\b\d{3}[ -]\d{3}[ -]\d{4}\b", 0.7), (r"\b\d{10}\b", 0.3), words=("nhs", "national health", "patient id", "patient number", "health number"), needs="[0-9]{4}"),
    _v("UKNINO", "UK_NINO", "en", C.uk_nino, strip_upper, (r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.85), words=("national insurance", "ni number", "nino")),
    _v("ITFiscalCode", "IT_FISCAL_CODE", "en it", C.it_fiscal_code, strip_upper, (r"\b[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]\b", 0.5), words=("codice fiscale", "fiscal code", "cf", "tax code"), needs="[A-Za-z]{6}[0-9]{2}"),
    _v("ITDriverLicense", "IT_DRIVER_LICENSE", "en it", C.it_driver_license, strip_upper, (r"\b[A-Za-z][Aa][A-Za-z0-9]{7}[A-Za-z]\b", 0.4), words=("patente", "patente di guida", "driver license", "driver licence", "driving licence"), keep_score=True, needs=None),
    _v("ITVATCode", "IT_VAT_CODE", "en it", C.it_vat, _vat, (r"\bIT\s?\d{11}\b", 0.6), words=("partita iva", "p.iva", "p iva", "vat", "vat number", "codice iva"), needs="IT"),
    _v("ITPassport", "IT_PASSPORT", "en it", None, None, (r"\b[A-Za-z]{2}\d{7}\b", 0.4), words=("passaporto", "passport", "passport number", "numero passaporto"), needs="[0-9]{7}"),
    _v("ITIdentityCard", "IT_IDENTITY_CARD", "en it", None, None, (r"\b[A-Za-z]{2}\d{5}[A-Za-z]{2}\b", 0.4), (r"\b[A-Za-z]{2}\d{7}\b", 0.3), words=("carta d'identita", "carta di identita", "identity card", "id card", "documento d'identita"), needs="[A-Za-z]{2}[0-9]{5}"),
    _v("ESNIF", "ES_NIF", "en es", C.es_nif, strip_upper, (r"\b\d{8}[A-Za-z]\b", 0.5), words=("nif", "dni", "documento nacional de identidad", "national id"), needs="[0-9]{8}[A-Za-z]"),
    _v("ESNIE", "ES_NIE", "en es", C.es_nie, strip_upper, (r"\b[XxYyZz]\d{7}[A-Za-z]\b", 0.5), words=("nie", "numero de identidad de extranjero", "foreigner id"), needs="[0-9]{7}[A-Za-z]"),
    _v("AUABN", "AU_ABN", "en", C.au_abn, strip, (r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", 0.6), words=("abn", "australian business number"), needs="[0-9]{3}"),
    _v("AUACN", "AU_ACN", "en", C.au_acn, strip, (r"\b\d{3}\s?\d{3}\s?\d{3}\b", 0.4), words=("acn", "australian company number"), needs="[0-9]{3}"),
    _v("AUTFN", "AU_TFN", "en", C.au_tfn, strip, (r"\b\d{3}\s?\d{3}\s?\d{3}\b", 0.4), (r"\b\d{3}\s?\d{2}\s?\d{3}\b", 0.3), words=("tfn", "tax file number"), needs="[0-9]{3}"),
    _v("AUMedicare", "AU_MEDICARE", "en", C.au_medicare, strip, (r"\b[2-6]\d{3}\s?\d{5}\s?\d\b", 0.6), words=("medicare", "medicare number", "medicare card"), needs="[0-9]{5}"),
    _v("INPAN", "IN_PAN", "en", C.in_pan, str.upper, (r"\b[A-Za-z]{5}\d{4}[A-Za-z]\b", 0.6), words=("pan", "pan number", "permanent account number"), needs="[0-9]{4}[A-Za-z]"),
    _v("INAadhaar", "IN_AADHAAR", "en", C.in_aadhaar, strip, (r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", 0.6), words=("aadhaar", "aadhar", "uid", "uidai"), needs="[0-9]{4}"),
    _v("INVehicleRegistration", "IN_VEHICLE_REGISTRATION", "en", None, None, (r"\b[A-Za-z]{2}[\s-]?\d{1,2}[\s-]?[A-Za-z]{1,3}[\s-]?\d{4}\b", 0.5), words=("vehicle", "registration", "rc number", "number plate", "vehicle number", "license plate"), needs="[0-9]{4}"),
    _v("INVoter", "IN_VOTER", "en", None, None, (r"\b[A-Za-z]{3}\d{7}\b", 0.5), words=("voter id", "epic", "epic number", "voter card", "election id"), needs="[A-Za-z]{3}[0-9]{7}"),
    _v("INPassport", "IN_PASSPORT", "en", None, None, (r"\b[A-PR-WYa-pr-wy]\d{7}\b", 0.5), words=("passport", "passport number", "indian passport"), needs="[0-9]{7}"),
    _v("PLPESEL", "PL_PESEL", "en pl", C.pl_pesel, strip, (r"\b\d{11}\b", 0.3), words=("pesel", "numer pesel", "national id"), needs="[0-9]{11}"),
    _v("SGNRIC", "SG_NRIC_FIN", "en", C.sg_nric, str.upper, (r"\b[STFGMstfgm]\d{7}[A-Za-z]\b", 0.6), words=("nric", "fin", "singapore id", "ic number", "identity card"), needs="[0-9]{7}[A-Za-z]"),
    _v("SGUEN", "SG_UEN", "en", None, None, (r"\b\d{9}[A-Za-z]\b", 0.4), (r"\b\d{8}[A-Za-z]\b", 0.3), (r"\b[TtSsRr]\d{2}[A-Za-z]{2}\d{4}[A-Za-z]\b", 0.5), words=("uen", "unique entity number", "company registration"), needs="[0-9]{4}[A-Za-z]"),
    _v("FIPersonalIdentityCode", "FI_PERSONAL_IDENTITY_CODE", "en fi", C.fi_hetu, str.upper, (r"\b\d{6}[+\-AaYyXxWwVvUuBbCcDdEeFf]\d{3}[A-Za-z0-9]\b", 0.6), words=("hetu", "henkilotunnus", "henkilötunnus", "personal identity code", "personal id"), needs="[0-9]{6}"),
    _v("KRRRN", "KR_RRN", "en ko", C.kr_rrn, strip, (r"\b\d{6}-?\d{7}\b", 0.5), words=("rrn", "resident registration", "주민등록번호", "주민번호"), needs="[0-9]{7}"),
]

ROMANIA = [
    _p("RomanianPhone", "PHONE_NUMBER", "*", (r"\b0\d{3}[-.\s]?\d{6,7}\b", 0.8), words=("tel", "telefon", "fax", "mobil", "celular", "contact"), needs="0[0-9]{3}"),
    _p("RomanianCNP", "ID", "*", (r"\b[1-8]\d{12}\b", 0.85), words=("CNP", "cod numeric", "C.I.F", "identificare"), needs="[0-9]{13}"),
    _p("RomanianVehicleReg", "ID", "*", (r"\bR\d{2}[-.\s]?\d{6,9}\b", 0.75), words=("amenda", "amenzi", "circulatie", "BORD", "rovineta"), needs="R[0-9]{2}"),
    _p("RomanianTreasuryAccount", "IBAN_CODE", "*", (r"(?:RO[A-Z0-9]{1,3})?TREZ[A-Z0-9]{10,30}\b", 0.85), words=("cont", "trezorerie", "TREZ", "IBAN"), needs="TREZ"),
    _p("RomanianStreet", "STREET_ADDRESS", "*", (rf"(?i)\b(?:strada|str\.|soseaua|sos\.|bd\.|bulevardul|aleea|calea|piata|piaţa|splaiul|intrarea)[\s.]+[{_RO}][{_RO}.'-]{{1,40}}(?:[\s,]+[{_RO}.'-]{{1,40}}){{0,5}}(?:[\s,]+(?:nr\.?|no\.?)[\s.]?\d{{1,5}}[A-Za-z]?)?", 0.8), words=("adresa", "domiciliu", "sediu", "address"), needs=r"(?i:strada|str\.|soseaua|sos\.|bd\.|bulevardul|aleea|calea|pia[tţ]a|splaiul|intrarea)[\s.]"),
    _p("RomanianObservation", "PERSON", "*", (r"\bObs[:.]\s*[A-ZĂÂÎȘȚŞŢ][A-ZĂÂÎȘȚŞŢ\s]{2,80}", 0.8), words=("Obs", "observatie", "observaţie"), needs="Obs"),
    _p("TimeOfDay", "DATE_TIME", "*", (r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?\b", 0.7), words=("ora", "time", "h", "AM", "PM"), needs="[0-9]:[0-9]"),
]

GERMANY = [
    _p("DEDateTime", "DATE_TIME", "de",
       (rf"\b{_DAY}\.[ \t]?(?:{_MONTHS_DE}|Jan|Feb|M(?:ä|ae)?r|Apr|Jun|Jul|Aug|Sep|Sept|Okt|Nov|Dez)\.?[ \t]+\d{{2,4}}\b", 0.95), (rf"\b(?:{_MONTHS_DE})[ \t]+\d{{4}}\b", 0.85), (rf"\b{_DAY}\.{_MONTH}\.\d{{2,4}}\b", 0.85), (rf"\b{_DAY}\.{_MONTH}[ \t]\d{{4}}\b", 0.65),
       words=("geboren", "geb", "datum", "vom", "am", "stattgehabt", "aufnahmedatum", "entlassdatum", "operationsdatum", "geburtsdatum", "geburtstag"), needs="[0-9]"),
    Recognizer("DEDateContextRecognizer", ("DATE_TIME",), ("de",), procedure="de_dates", needs="[0-9]"),
    _p("DEPhone", "PHONE_NUMBER", "de", (r"\b0\d{2,5}\/\s?\d{3,10}(?:[-\s]\d{1,8})?\b", 0.85), (r"\b0\d{2,4}[-\s]\d{2,5}[-\s]?\d{2,8}\b", 0.75), (r"\(\s?0\d{2,4}\s?\)\s?\d{2,6}(?:\s?[-\s]\s?\d{1,8})?", 0.85), (r"\+(?:49|43|41)\s?(?:\(0\)\s?\d{1,5}|\(\d{1,5}\)|\d{1,5})(?:[\s-]+\d{1,8}){0,4}", 0.85), words=("telefon", "tel", "tel.", "fon", "handy", "mobil", "mobile", "fax", "telefax", "rufnummer", "durchwahl", "erreichbar", "kontakt"), needs="0[0-9]|[+]4"),
    Recognizer("DEPostalCodeRecognizer", ("POSTAL_CODE",), ("de",), procedure="de_postal", needs="[0-9]{4}"),
    _p("DEStreet", "STREET_ADDRESS", "de",
       (rf"\b{_U}[a-zäöüß-]{{2,30}}(?:stra(?:ß|ss)e|str\.|pfad|gasse|allee|platz|kamp)(?:\s+\d{{1,4}}\s?[a-z]?)?\b", 0.8), (rf"\b{_U}[a-zäöüß-]{{2,30}}(?:weg|ring|steig|gang|chaussee|promenade)\s+\d{{1,4}}\s?[a-z]?\b", 0.82),
       (rf"\b{_U}[a-zäöüß-]{{2,30}}\s+(?:Stra(?:ß|ss)e|Str\.|Weg|Platz|Pfad|Gasse|Kamp|Allee|Ring|Promenade|Steig|Gang|Chaussee)\.?(?:\s+\d{{1,4}}\s?[a-z]?)?\b", 0.85), (rf"\b(?:Am|Im|An\s+der|An\s+den)\s+{_U}[a-zäöüß-]{{2,30}}(?:\s+{_U}[a-zäöüß-]+){{0,2}}\s+\d{{1,4}}\s?[a-z]?\b", 0.8),
       words=("anschrift", "adresse", "wohnhaft", "wohnort", "hausarzt", "patient"), needs=r"[Ss]tr|[Pp](?:fad|latz)|[Gg]a(?:sse|ng)|[Aa]llee|[Kk]amp|[0-9]|Weg|Ring|Promenade|Steig|Chaussee"),
    _v("DESteuerID", "DE_STEUER_ID", "de", C.de_steuer_id, strip, (r"\b\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}\b", 0.5), (r"\b\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{1}\b", 0.5), words=("steuer-id", "steueridentifikationsnummer", "steuerliche identifikationsnummer", "steuernummer", "tin", "tax id"), needs="[0-9]{3}"),
    _p("DEAge", "AGE", "de", (rf"(?i)\b{_AGE}[-\s]?j[äaä]hrige[nrms]?\b", 0.9), (rf"(?i)\b{_AGE}[-\s]?j[äaä]hrig(?:e[nrms]?)?\b", 0.85), (rf"(?i)\b{_AGE}\s+(?:jahre|j\.)\s+alt\b", 0.85), (rf"(?i)\b{_AGE}\s+jahre[,;)\s]", 0.78), (rf"(?i)\b(?:Patient|Patientin|Pat\.)\s*\({_AGE}\)", 0.85), (rf"(?i)\bim\s+Alter\s+von\s+{_AGE}\b", 0.9), (rf"(?i)\b(?:Lebensalter|Alter)\s*[:.]?\s*{_AGE}\b", 0.8), words=("alter", "jahre", "jahrgang", "geburtsjahr", "patient", "patientin", "pat."), needs="[0-9]"),
    Recognizer("DEPlaceRecognizer", ("LOCATION",), ("de",), procedure="de_places"),
    Recognizer("DEClinicalIDRecognizer", ("ID",), ("de", "en"), procedure="de_record_ids", needs=r"[0-9]|(?:tation|mbulanz|Onkologie|OP|Bett|Zimmer|Etage|Gebäude|Ward|Room|Unit|Bed|Floor|Suite|ICU|Emergency)\s+[IVX]"),
    _p("DEOrganization", "ORGANIZATION", "de",
       (r"(?i)\b(?:Charit[ée]|Vivantes|Asklepios|Helios|Sana|MediClin|Schön[ \t]+Klinik|Rhön-?Klinikum|Diakonissenkrankenhaus)\b", 0.9),
       (r"(?i)\b(?:Universit[äa]tsklinik(?:um)?|Universit[äa]tsspital|Klinikum|Krankenhaus|Medizinische[ \t]+Hochschule|Fachklinik|Reha-?Klinik|Praxis[ \t]+(?:Dr\.|Prof\.|für[ \t]+\w+))[ \t]+[a-zäöüß][a-zäöüß-]+(?:[ \t]+[a-zäöüß][a-zäöüß-]+){0,2}", 0.85),
       (r"(?i)\b[a-zäöüß][a-zäöüß-]{2,30}(?:[- ](?:Klinikum|Krankenhaus|Klinik|Zentrum|Spital|Hospital|Praxis|Ambulanz|Reha-?Zentrum))\b", 0.8),
       words=("klinik", "klinikum", "krankenhaus", "praxis", "abteilung", "station", "behandelnde", "einweisende"), needs=r"(?i:klini|kranken|hochschule|praxis|zentrum|spital|hospital|ambulanz|charit|vivantes|asklepios|helios|sana|mediclin)"),
    _p("DELegalFinanceOrg", "ORGANIZATION", "de",
       (rf"\b(?:Amtsgericht|Landgericht|Oberlandesgericht|Bundesgerichtshof|BGH|Arbeitsgericht|Landesarbeitsgericht|Bundesarbeitsgericht|BAG|Sozialgericht|Landessozialgericht|Bundessozialgericht|BSG|Finanzgericht|Bundesfinanzhof|BFH|Verwaltungsgericht|Oberverwaltungsgericht|Bundesverwaltungsgericht|BVerwG|Bundesverfassungsgericht|BVerfG|Bundespatentgericht)(?:[ \t]+{_NAME}){{0,3}}\b", 0.9),
       (rf"\b(?:Bundesamt|Landesamt|Kreisamt|Stadtamt|Finanzamt|Hauptzollamt|Zollamt|Sozialamt|Jugendamt|Ordnungsamt|Standesamt|Gewerbeamt|Einwohnermeldeamt|Gesundheitsamt|Polizeipr[äa]sidium|Polizeidirektion|Polizeiinspektion|Polizeirevier|Staatsanwaltschaft|Generalstaatsanwaltschaft|Ministerium|Bundesministerium|Landesministerium|Beh[öo]rde|Bundesbeh[öo]rde|Landesbeh[öo]rde)(?:[ \t]+(?:f[üu]r|der|des|von)[ \t]+{_U}{_L}+(?:[ \t]+und[ \t]+{_U}{_L}+)?)?(?:[ \t]+{_NAME}){{0,2}}\b", 0.88),
       (rf"\b(?:KfW(?:[ \t]+Bankengruppe)?|HypoVereinsbank|HypoRealEstate|Deutsche[ \t]+Bank|Commerzbank|Postbank|DKB|ING-DiBa|ING|Targobank|N26|DZ[ \t]+Bank|Apobank|BBBank|PSD[ \t]+Bank|LBBW|BayernLB|NordLB|HSH[ \t]+Nordbank|Helaba|Landesbank[ \t]+{_U}[a-zäöüß-]+|DekaBank|Berenberg|M\.M\.[ \t]+Warburg(?:[ \t]+&[ \t]+Co\.?)?|Metzler|Hauck[ \t]+Aufh[äa]user|(?:Sparkasse|Volksbank|Raiffeisenbank|VR-Bank|Genobank|PSD[ \t]+Bank|Sparda-?Bank)(?:[- ]{_NAME}(?:[ \t]+{_NAME}){{0,2}})?)(?:[ \t]+eG)?\b", 0.88),
       (rf"\b(?:Kanzlei|Rechtsanwaltskanzlei|Notariat|Sozietät|Anwaltskanzlei)[ \t]+{_U}{_L}+(?:[ \t]*[&,][ \t]*{_U}{_L}+){{0,4}}(?:[ \t]*&[ \t]*(?:Kollegen|Partner|Partnerschaft))?\b", 0.85),
       (rf"\b(?:Firma[ \t]+)?{_U}[A-Za-zäöüß0-9.&'-]+(?:[ \t]+(?:&[ \t]+)?{_U}[A-Za-zäöüß0-9.&'-]+){{0,5}}[ \t]+(?:GmbH(?:[ \t]+&[ \t]+Co\.?[ \t]+(?:KG|KGaA|OHG))?|AG|KGaA|KG|OHG|oHG|e\.?V\.?|e\.?K\.?|SE|UG(?:[ \t]*\(haftungsbeschr[äa]nkt\))?|PartG(?:mbB)?|Stiftung(?:[ \t]+b[üu]rgerlichen[ \t]+Rechts)?)\b", 0.82),
       words=("gericht", "kanzlei", "rechtsanwalt", "notar", "richter", "kläger", "beklagter", "bank", "sparkasse", "iban", "konto", "kontoauszug", "kundennummer", "amt", "behörde", "ministerium", "verfügung", "bescheid", "firma", "gesellschaft", "geschäft"), needs=r"gericht|finanzhof|BGH|BAG|BSG|BFH|BVer|amt\b|Poliz|[Aa]nwalt|inisterium|eh[öo]rde|[Bb]ank|Hypo|DKB|ING|N26|LB|Helaba|Berenberg|Warburg|Metzler|Hauck|KfW|kasse|Kanzlei|Notariat|Soziet|GmbH|[AK]G|HG|e\.?V|e\.?K|SE|UG|PartG|Stiftung"),
    _p("BIC", "ID", "*", (rf"\b[A-Z]{{4}}(?:{COUNTRIES_BIC})[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?\b", 0.9), needs="[A-Z]{6}"),
    _p("ISIN", "ID", "*", (rf"\b(?:{COUNTRIES_ISIN})[A-Z0-9]{{9}}\d\b", 0.95), check=C.isin, keep_score=True, needs="[A-Z]{2}[A-Z0-9]{9}[0-9]"),
    Recognizer("DEProfessionRecognizer", ("PROFESSION",), ("de",), procedure="de_professions"),
    Recognizer("DEAnomalyRecognizer", ("PERSON",), ("de",), procedure="de_names"),
]

#: Defined, but not among the defaults: amounts of money are not personal data.
MONEY = _p("RomanianMoney", "MONEY", "*", (r"\b\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?\s*(?:lei|LEI|RON|EUR|USD|euro)\b", 0.8), words=("suma", "total", "amount", "cuantum", "datorat"), needs="[0-9]")

DEFAULT = [*GENERIC, *US, *SHARED, *REGIONAL, *ROMANIA, *GERMANY]
