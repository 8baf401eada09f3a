"""Word lists and tables of the text kernel, the demand engine and search.

Everything here is data: fixed values that queries depend on.
"""

from __future__ import annotations

#: Letters that queries are extended with, by script.
CONSONANTS = {
    "devanagari": list("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"),
    "tamil": list("கஙசஞடணதநபமயரலவழளறன"),
    "telugu": list("కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరలవశషసహ"),
    "bengali": list("কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলবশষসহ"),
    "gujarati": list("કખગઘઙચછજઝઞટઠડઢણતથદધનપફબભમયરલવશષસહ"),
    "kannada": list("ಕಖಗಘಙಚಛಜಝಞಟಠಡಢಣತಥದಧನಪಫಬಭಮಯರಲವಶಷಸಹ"),
    "malayalam": list("കഖഗഘങചഛജഝഞടഠഡഢണതഥദധനപഫബഭമയരലവശഷസഹ"),
    "gurmukhi": list("ਕਖਗਘਙਚਛਜਝਞਟਠਡਢਣਤਥਦਧਨਪਫਬਭਮਯਰਲਵਸਹ"),
    "oriya": list("କଖଗଘଙଚଛଜଝଞଟଠଡଢଣତଥଦଧନପଫବଭମଯରଲୱଶଷସହ"),
    "latin": list("abcdefghijklmnopqrstuvwxyz"),
}

#: Languages with question templates, modifiers (text, intent) and intent markers.
LANGUAGES = {
    "mr": {
        "name": "Marathi", "native_name": "मराठी", "script": "devanagari", "consonants": "devanagari",
        "questions": ["{t} काय", "{t} का", "{t} कसे", "{t} कधी", "{t} कुठे", "{t} किती", "{t} कोणते"],
        "modifiers": [("माहिती", "informational"), ("pdf", "transactional"), ("विनामूल्य", "transactional"), ("उदाहरण", "informational"), ("2026", "freshness"), ("नियम", "informational"), ("यादी", "informational"), ("तुलना", "comparison")],
        "markers": {
            "transactional": ["खरेदी", "किंमत", "डाउनलोड", "pdf", "विनामूल्य", "दुकान", "buy", "price", "download", "free"],
            "navigational": ["लॉगिन", "पोर्टल", "वेबसाईट", "अधिकृत", "login", "portal", "website", "official", "gov.in"],
            "howto": ["कसे करावे", "कसे", "मार्गदर्शक", "कृती", "पद्धत", "how to", "steps"],
            "freshness": ["2026", "2025", "आज", "ताज्या", "नवीन", "latest", "today", "news"],
            "comparison": ["तुलना", "फरक", "सर्वोत्तम", "विरुद्ध", "vs", "versus", "best", "compare"],
            "informational": ["काय", "माहिती", "अर्थ", "नियम", "यादी", "इतिहास", "what is", "meaning", "list", "info"],
        },
    },
    "hi": {
        "name": "Hindi", "native_name": "हिन्दी", "script": "devanagari", "consonants": "devanagari",
        "questions": ["{t} क्या है", "{t} क्यों", "{t} कैसे", "{t} कब", "{t} कहां", "{t} कितना", "{t} कौन सा"],
        "modifiers": [("जानकारी", "informational"), ("pdf", "transactional"), ("फ्री", "transactional"), ("उदाहरण", "informational"), ("2026", "freshness"), ("नियम", "informational"), ("लिस्ट", "informational"), ("तुलना", "comparison")],
        "markers": {
            "transactional": ["खरीदें", "कीमत", "डाउनलोड", "pdf", "मुफ्त", "दुकान", "buy", "price", "download", "free"],
            "navigational": ["लॉगिन", "पोर्टल", "वेबसाइट", "आधिकारिक", "login", "portal", "website", "official"],
            "howto": ["कैसे करें", "तरीका", "कदम", "गाइड", "how to", "process"],
            "freshness": ["2026", "2025", "आज", "ताजा", "नया", "latest", "today", "news"],
            "comparison": ["तुलना", "अंतर", "सबसे अच्छा", "बनाम", "vs", "versus", "best"],
            "informational": ["क्या है", "जानकारी", "मतलब", "नियम", "सूची", "what is", "meaning", "info"],
        },
    },
    "ta": {
        "name": "Tamil", "native_name": "தமிழ்", "script": "tamil", "consonants": "tamil",
        "questions": ["{t} என்ன", "{t} ஏன்", "{t} எப்படி", "{t} எப்போது", "{t} எங்கே", "{t} எத்தனை", "{t} எது"],
        "modifiers": [("தகவல்", "informational"), ("pdf", "transactional"), ("இலவச", "transactional"), ("உதாரணம்", "informational"), ("2026", "freshness"), ("விதிகள்", "informational"), ("பட்டியல்", "informational"), ("ஒப்பீடு", "comparison")],
        "markers": {
            "transactional": ["வாங்க", "விலை", "பதிவிறக்க", "pdf", "இலவச", "buy", "price", "download", "free"],
            "navigational": ["உள்நுழைவு", "இணையதளம்", "போர்ட்டல்", "login", "portal", "website", "official"],
            "howto": ["எப்படி செய்வது", "வழிமுறை", "முறை", "how to"],
            "freshness": ["2026", "2025", "இன்று", "புதிய", "latest", "today", "news"],
            "comparison": ["ஒப்பீடு", "வித்தியாசம்", "சிறந்த", "vs", "versus", "best"],
            "informational": ["என்ன", "தகவல்", "அர்த்தம்", "விளக்கம்", "what is", "meaning"],
        },
    },
    "te": {
        "name": "Telugu", "native_name": "తెలుగు", "script": "telugu", "consonants": "telugu",
        "questions": ["{t} ఏమిటి", "{t} ఎందుకు", "{t} ఎలా", "{t} ఎప్పుడు", "{t} ఎక్కడ", "{t} ఎంత", "{t} ఏది"],
        "modifiers": [("సమాచారం", "informational"), ("pdf", "transactional"), ("ఉచిత", "transactional"), ("ఉదాహరణ", "informational"), ("2026", "freshness"), ("నియమాలు", "informational"), ("జాబితా", "informational"), ("పోలిక", "comparison")],
        "markers": {
            "transactional": ["కొనుగోలు", "ధర", "డౌన్లోడ్", "pdf", "ఉచిత", "buy", "price", "download", "free"],
            "navigational": ["లాగిన్", "పోర్టల్", "వెబ్‌సైట్", "login", "portal", "website", "official"],
            "howto": ["ఎలా చేయాలి", "విధానం", "పద్ధతి", "how to"],
            "freshness": ["2026", "2025", "ఈరోజు", "తాజా", "కొత్త", "latest", "today", "news"],
            "comparison": ["పోలిక", "తేడా", "ఉత్తమ", "vs", "versus", "best"],
            "informational": ["ఏమిటి", "సమాచారం", "అర్థం", "వివరణ", "what is", "meaning"],
        },
    },
    "bn": {
        "name": "Bengali", "native_name": "বাংলা", "script": "bengali", "consonants": "bengali",
        "questions": ["{t} কি", "{t} কেন", "{t} কিভাবে", "{t} কখন", "{t} কোথায়", "{t} কত", "{t} কোনটি"],
        "modifiers": [("তথ্য", "informational"), ("pdf", "transactional"), ("ফ্রি", "transactional"), ("উদাহরণ", "informational"), ("2026", "freshness"), ("নিয়ম", "informational"), ("তালিকা", "informational"), ("তুলনা", "comparison")],
        "markers": {
            "transactional": ["কেনা", "দাম", "ডাউনলোড", "pdf", "ফ্রি", "buy", "price", "download", "free"],
            "navigational": ["লগইন", "পোর্টাল", "ওয়েবসাইট", "login", "portal", "website", "official"],
            "howto": ["কিভাবে করবেন", "পদ্ধতি", "নিয়মাবলী", "how to"],
            "freshness": ["2026", "2025", "আজ", "তাজা", "নতুন", "latest", "today", "news"],
            "comparison": ["তুলনা", "পার্থক্য", "সেরা", "vs", "versus", "best"],
            "informational": ["কি", "তথ্য", "মানে", "বিবরণ", "what is", "meaning"],
        },
    },
    "gu": {
        "name": "Gujarati", "native_name": "ગુજરાતી", "script": "gujarati", "consonants": "gujarati",
        "questions": ["{t} શું છે", "{t} કેમ", "{t} કેવી રીતે", "{t} ક્યારે", "{t} ક્યાં", "{t} કેટલું", "{t} કયું"],
        "modifiers": [("માહિતી", "informational"), ("pdf", "transactional"), ("મફત", "transactional"), ("ઉદાહરણ", "informational"), ("2026", "freshness"), ("નિયમો", "informational"), ("યાદી", "informational"), ("સરખામણી", "comparison")],
        "markers": {
            "transactional": ["ખરીદો", "કિંમત", "ડાઉનલોડ", "pdf", "મફત", "buy", "price", "download", "free"],
            "navigational": ["લૉગિન", "પોર્ટલ", "વેબસાઇટ", "login", "portal", "website", "official"],
            "howto": ["કેવી રીતે કરવું", "રીત", "પદ્ધતિ", "how to"],
            "freshness": ["2026", "2025", "આજે", "તાજા", "નવું", "latest", "today", "news"],
            "comparison": ["સરખામણી", "તફાવત", "શ્રેષ્ઠ", "vs", "versus", "best"],
            "informational": ["શું છે", "માહિતી", "અર્થ", "યાદી", "what is", "meaning"],
        },
    },
    "kn": {
        "name": "Kannada", "native_name": "ಕನ್ನಡ", "script": "kannada", "consonants": "kannada",
        "questions": ["{t} ಏನು", "{t} ಏಕೆ", "{t} ಹೇಗೆ", "{t} ಯಾವಾಗ", "{t} ಎಲ್ಲಿ", "{t} ಎಷ್ಟು", "{t} ಯಾವುದು"],
        "modifiers": [("ಮಾಹಿತಿ", "informational"), ("pdf", "transactional"), ("ಉಚಿತ", "transactional"), ("ಉದಾಹರಣೆ", "informational"), ("2026", "freshness"), ("ನಿಯಮಗಳು", "informational"), ("ಪಟ್ಟಿ", "informational"), ("ಹೋಲಿಕೆ", "comparison")],
        "markers": {
            "transactional": ["ಖರೀದಿಸಿ", "ಬೆಲೆ", "ಡೌನ್ಲೋಡ್", "pdf", "ಉಚಿತ", "buy", "price", "download", "free"],
            "navigational": ["ಲಾಗಿನ್", "ಪೋರ್ಟಲ್", "ವೆಬ್‌ಸೈಟ್", "login", "portal", "website", "official"],
            "howto": ["ಹೇಗೆ ಮಾಡುವುದು", "ವಿಧಾನ", "ಕ್ರಮ", "how to"],
            "freshness": ["2026", "2025", "ಇಂದು", "ತಾಜಾ", "ಹೊಸ", "latest", "today", "news"],
            "comparison": ["ಹೋಲಿಕೆ", "ವ್ಯತ್ಯಾಸ", "ಉತ್ತಮ", "vs", "versus", "best"],
            "informational": ["ಏನು", "ಮಾಹಿತಿ", "ಅರ್ಥ", "ವಿವರ", "what is", "meaning"],
        },
    },
    "ml": {
        "name": "Malayalam", "native_name": "മലയാളം", "script": "malayalam", "consonants": "malayalam",
        "questions": ["{t} എന്താണ്", "{t} എന്തുകൊണ്ട്", "{t} എങ്ങനെ", "{t} എപ്പോൾ", "{t} എവിടെ", "{t} എത്ര", "{t} ഏത്"],
        "modifiers": [("വിവരങ്ങൾ", "informational"), ("pdf", "transactional"), ("സൗജന്യം", "transactional"), ("ഉദാഹരണം", "informational"), ("2026", "freshness"), ("നിയമങ്ങൾ", "informational"), ("പട്ടിക", "informational"), ("താരതമ്യം", "comparison")],
        "markers": {
            "transactional": ["വാങ്ങുക", "വില", "ഡൗൺലോഡ്", "pdf", "സൗജന്യം", "buy", "price", "download", "free"],
            "navigational": ["ലോഗിൻ", "പോർട്ടൽ", "വെബ്സൈറ്റ്", "login", "portal", "website", "official"],
            "howto": ["എങ്ങനെ ചെയ്യാം", "രീതി", "വഴികൾ", "how to"],
            "freshness": ["2026", "2025", "ഇന്ന്", "പുതിയ", "latest", "today", "news"],
            "comparison": ["താരതമ്യം", "വ്യത്യാസം", "മികച്ച", "vs", "versus", "best"],
            "informational": ["എന്താണ്", "വിവരങ്ങൾ", "അർത്ഥം", "വിവരണം", "what is", "meaning"],
        },
    },
    "pa": {
        "name": "Punjabi", "native_name": "ਪੰਜਾਬੀ", "script": "gurmukhi", "consonants": "gurmukhi",
        "questions": ["{t} ਕੀ ਹੈ", "{t} ਕਿਉਂ", "{t} ਕਿਵੇਂ", "{t} ਕਦੋਂ", "{t} ਕਿੱਥੇ", "{t} ਕਿੰਨਾ", "{t} ਕਿਹੜਾ"],
        "modifiers": [("ਜਾਣਕਾਰੀ", "informational"), ("pdf", "transactional"), ("ਮੁਫ਼ਤ", "transactional"), ("ਉਦਾਹਰਣ", "informational"), ("2026", "freshness"), ("ਨਿਯਮ", "informational"), ("ਸੂਚੀ", "informational"), ("ਤੁਲਨਾ", "comparison")],
        "markers": {
            "transactional": ["ਖਰੀਦੋ", "ਕੀਮਤ", "ਡਾਊਨਲੋਡ", "pdf", "ਮੁਫ਼ਤ", "buy", "price", "download", "free"],
            "navigational": ["ਲਾਗਇਨ", "ਪੋਰਟਲ", "ਵੈੱਬਸਾਈਟ", "login", "portal", "website", "official"],
            "howto": ["ਕਿਵੇਂ ਕਰੀਏ", "ਤਰੀਕਾ", "ਢੰਗ", "how to"],
            "freshness": ["2026", "2025", "ਅੱਜ", "ਤਾਜ਼ਾ", "ਨਵਾਂ", "latest", "today", "news"],
            "comparison": ["ਤੁਲਨਾ", "ਫ਼ਰਕ", "ਵਧੀਆ", "vs", "versus", "best"],
            "informational": ["ਕੀ ਹੈ", "ਜਾਣਕਾਰੀ", "ਅਰਥ", "ਸੂਚੀ", "what is", "meaning"],
        },
    },
    "or": {
        "name": "Odia", "native_name": "ଓଡ଼ିଆ", "script": "oriya", "consonants": "oriya",
        "questions": ["{t} କଣ", "{t} କାହିଁକି", "{t} କିପରି", "{t} କେବେ", "{t} କେଉଁଠି", "{t} କେତେ", "{t} କେଉଁଟି"],
        "modifiers": [("ତଥ୍ୟ", "informational"), ("pdf", "transactional"), ("ମାଗଣା", "transactional"), ("ଉଦାହରଣ", "informational"), ("2026", "freshness"), ("ନିୟମ", "informational"), ("ତାଲିକା", "informational"), ("ତୁଳନା", "comparison")],
        "markers": {
            "transactional": ["କିଣନ୍ତୁ", "ମୂଲ୍ୟ", "ଡାଉନଲୋଡ୍", "pdf", "ମାଗଣା", "buy", "price", "download", "free"],
            "navigational": ["ଲଗଇନ୍", "ପୋର୍ଟାଲ୍", "ୱେବସାଇଟ୍", "login", "portal", "website", "official"],
            "howto": ["କିପରି କରିବେ", "ପଦ୍ଧତି", "ଉପାୟ", "how to"],
            "freshness": ["2026", "2025", "ଆଜି", "ତାଜା", "ନୂଆ", "latest", "today", "news"],
            "comparison": ["ତୁଳନା", "ପାର୍ଥକ୍ୟ", "ସର୍ବୋତ୍ତମ", "vs", "versus", "best"],
            "informational": ["କଣ", "ତଥ୍ୟ", "ଅର୍ଥ", "ତାଲିକା", "what is", "meaning"],
        },
    },
    "en": {
        "name": "English", "native_name": "English", "script": "latin", "consonants": "latin",
        "questions": ["how to {t}", "what is {t}", "why {t}", "when {t}", "where {t}", "{t} price", "{t} online"],
        "modifiers": [("guide", "informational"), ("pdf", "transactional"), ("free", "transactional"), ("examples", "informational"), ("2026", "freshness"), ("rules", "informational"), ("list", "informational"), ("vs", "comparison")],
        "markers": {
            "transactional": ["buy", "price", "download", "pdf", "free", "discount", "cost", "cheap", "purchase", "order"],
            "navigational": ["login", "portal", "website", "official", "gov.in", "app", "dashboard"],
            "howto": ["how to", "tutorial", "guide", "steps", "process", "tips", "recipe"],
            "freshness": ["2026", "2025", "latest", "today", "news", "updates", "new"],
            "comparison": ["vs", "versus", "best", "compare", "alternative", "review", "top 10"],
            "informational": ["what is", "meaning", "definition", "examples", "list", "rules", "info", "history"],
        },
    },
}

#: Commercial modifiers (text, aspect) by language.
COMMERCIAL = {
    "mr": [("किंमत", "commercial_price"), ("दर 2026", "commercial_price"), ("रिव्ह्यू", "commercial_review"), ("खरे की खोटे", "commercial_trust"), ("वॉरंटी", "commercial_warranty"), ("अनुदान", "commercial_subsidy"), ("vs", "commercial_vs"), ("कसा वापरायचा", "commercial_demo"), ("सर्वोत्तम", "commercial_best"), ("च्या आत", "commercial_budget")],
    "hi": [("कीमत", "commercial_price"), ("प्राइस 2026", "commercial_price"), ("रिव्यू", "commercial_review"), ("असली या नकली", "commercial_trust"), ("वारंटी", "commercial_warranty"), ("सब्सिडी", "commercial_subsidy"), ("vs", "commercial_vs"), ("कैसे इस्तेमाल करें", "commercial_demo"), ("सबसे अच्छा", "commercial_best"), ("के अंदर", "commercial_budget")],
    "en": [("price 2026", "commercial_price"), ("review", "commercial_review"), ("original vs fake", "commercial_trust"), ("warranty", "commercial_warranty"), ("subsidy", "commercial_subsidy"), ("versus", "commercial_vs"), ("how to use", "commercial_demo"), ("best", "commercial_best"), ("under", "commercial_budget"), ("complaints", "commercial_trust")],
    "ta": [("விலை", "commercial_price"), ("மதிப்புரை", "commercial_review"), ("உண்மை அல்லது போலி", "commercial_trust"), ("உத்தரவாதம்", "commercial_warranty"), ("மானிய", "commercial_subsidy"), ("ஒப்பீடு", "commercial_vs"), ("சிறந்த", "commercial_best")],
    "te": [("ధర", "commercial_price"), ("రివ్యూ", "commercial_review"), ("అసలైన లేదా నకిలీ", "commercial_trust"), ("వారంటీ", "commercial_warranty"), ("సబ్సిడీ", "commercial_subsidy"), ("పోలిక", "commercial_vs"), ("ఉత్తమ", "commercial_best")],
    "bn": [("দাম", "commercial_price"), ("রিভিউ", "commercial_review"), ("আসল না নকল", "commercial_trust"), ("ওয়ারেন্টি", "commercial_warranty"), ("ভর্তুকি", "commercial_subsidy"), ("তুলনা", "commercial_vs"), ("সেরা", "commercial_best")],
    "gu": [("કિંમત", "commercial_price"), ("રિવ્યુ", "commercial_review"), ("અસલી કે નકલી", "commercial_trust"), ("વોરંટી", "commercial_warranty"), ("સબસિડી", "commercial_subsidy"), ("સરખામણી", "commercial_vs"), ("શ્રેષ્ઠ", "commercial_best")],
    "kn": [("ಬೆಲೆ", "commercial_price"), ("ವಿಮರ್ಶೆ", "commercial_review"), ("ಅಸಲಿ ಅಥವಾ ನಕಲಿ", "commercial_trust"), ("ವಾರಂಟಿ", "commercial_warranty"), ("ಸಬ್ಸಿಡಿ", "commercial_subsidy"), ("ಹೋಲಿಕೆ", "commercial_vs"), ("ಉತ್ತಮ", "commercial_best")],
    "ml": [("വില", "commercial_price"), ("റിവ്യൂ", "commercial_review"), ("യഥാർത്ഥമോ വ്യാജമോ", "commercial_trust"), ("വാറന്റി", "commercial_warranty"), ("സബ്‌സിഡി", "commercial_subsidy"), ("താരതമ്യം", "commercial_vs"), ("മികച്ച", "commercial_best")],
    "pa": [("ਮੁੱਲ", "commercial_price"), ("ਰੀਵਿਊ", "commercial_review"), ("ਅਸਲੀ ਜਾਂ ਨਕਲੀ", "commercial_trust"), ("ਵਾਰੰਟੀ", "commercial_warranty"), ("ਸਬਸਿਡੀ", "commercial_subsidy"), ("ਤੁਲਨਾ", "commercial_vs"), ("ਸਭ ਤੋਂ ਵਧੀਆ", "commercial_best")],
    "or": [("ମୂଲ୍ୟ", "commercial_price"), ("ରିଭ୍ୟୁ", "commercial_review"), ("ଅସଲି କି ନକଲି", "commercial_trust"), ("ୱାରେଣ୍ଟି", "commercial_warranty"), ("ସବସିଡି", "commercial_subsidy"), ("ତୁଳନା", "commercial_vs"), ("ସର୍ବୋତ୍ତମ", "commercial_best")],
}

#: Buyer-intent categories in order, each with its tokens.
BUYER_INTENT = {
    "price": ["किंमत", "दर", "भाव", "कीमत", "दाम", "price", "pricing", "cost", "rate", "discount", "offer", "offers", "sale", "deal", "deals", "सस्ता", "कमी भाव", "விலை", "ధర", "দাম", "કિંમત", "ಬೆಲೆ", "വില", "ਮੁੱਲ", "ମୂଲ୍ୟ"],
    "trust": ["खरे की खोटे", "असली या नकली", "original vs fake", "real vs fake", "duplicate", "डुप्लिकेट", "तक्रार", "शिकायत", "complaint", "complaints", "scam", "fraud", "कस्टमर केअर", "customer care", "toll free", "हेल्पलाईन", "helpline", "फसवणूक", "fake", "genuine", "original", "असली", "खरे"],
    "warranty": ["वॉरंटी", "वारंटी", "गारंटी", "गॅरंटी", "warranty", "guarantee", "सर्व्हिस सेंटर", "service center", "spare part", "पार्ट्स", "स्पेअर पार्ट", "repair"],
    "subsidy": ["अनुदान", "सब्सिडी", "योजना", "subsidy", "subsidies", "mahadbt", "pm kisan", "surya ghar", "dbt", "yojana", "सूट", "कर्ज", "loan", "योजना 2026", "योजना 2025"],
    "comparison": ["vs", "versus", "तुलना", "विरुद्ध", "बनाम", "फरक", "अंतर", "तुलना करा", "compare", "comparison"],
    "review": ["रिव्ह्यू", "रिव्यू", "review", "reviews", "rating", "ratings", "सर्वोत्तम", "सर्वोत्कृष्ट", "सबसे अच्छा", "best", "top 10", "top 5", "reasons to buy", "चांगला", "चांगली"],
    "budget": ["च्या आत", "च्या खाली", "के अंदर", "under", "बजेट", "budget", "कमी बजेट", "किफायती"],
    "purchase": ["खरेदी", "खरीदें", "buy", "purchase", "order", "online shopping", "cod", "cash on delivery", "दुकान"],
}

#: Intents in order of precedence, and the article shape of each.
INTENTS = ["transactional", "navigational", "howto", "freshness", "comparison", "informational"]

#: Labels of search intents, and of what pages for them look like.
INTENT_LABELS = {
    "freshness": "📰 ताज्या घडामोडी शोध (Freshness Intent)",
    "informational": "📖 माहिती व संदर्भ शोध (Informational Intent)",
    "howto": "🛠️ कार्यपद्धती व मार्गदर्शक (How-to Guide)",
    "transactional": "💼 योजना, सेवा व अर्ज शोध (Transactional Intent)",
    "comparison": "⚖️ तुलना व मूल्यमापन (Comparison Intent)",
    "navigational": "🌐 अधिकृत संकेतस्थळ शोध (Navigational Intent)",
    "unclear": "🔍 सर्वसाधारण मराठी शोध",
}
SHAPE_LABELS = {
    "freshness": "दिनांकित व सर्वात अद्ययावत वृत्तपेज",
    "informational": "सविस्तर विश्लेषणात्मक व संदर्भ माहिती",
    "howto": "टप्प्याटप्प्याने मार्गदर्शक कृती व कार्यपद्धती",
    "transactional": "अधिकृत पोर्टल, नोंदणी अर्ज किंवा लाभार्थी यादी",
    "comparison": "तुलनात्मक तक्ता व निकष मूल्यांकन",
    "navigational": "अधिकृत मुख्य संकेतस्थळ",
    "unclear": "विश्वसनीय मराठी वृत्त व माहिती",
}

ARTICLE_SHAPES = {
    "informational": "Explainer or reference pillar page",
    "howto": "Step-by-step practical guide",
    "transactional": "Offer, pricing, or product landing page (not a blog post)",
    "navigational": "Do not target (brand or portal lookup)",
    "freshness": "Dated page with visible update history",
    "comparison": "Even-handed comparison table and evaluation",
    "unclear": "Research further; intent markers found nothing",
}

#: Question words by language, and romanised ones.
QUESTION_WORDS = {
    "mr": ["काय", "का", "कसे", "कशी", "कसा", "कधी", "कुठे", "कोठे", "किती", "कोणते", "कोणती", "कोणता", "कोण", "कशाला", "कशासाठी"],
    "hi": ["क्या", "क्यों", "कैसे", "कैसा", "कैसी", "कब", "कहाँ", "कहा", "कितना", "कितनी", "कितने", "कौन", "किसे", "किसका"],
    "ta": ["என்ன", "ஏன்", "எப்படி", "எப்போது", "எங்கே", "எத்தனை", "எது", "யார்"],
    "te": ["ఏమిటి", "ఎందుకు", "ఎలా", "ఎప్పుడు", "ఎక్కడ", "ఎంత", "ఏది", "ఎవరు"],
    "bn": ["কি", "কেন", "কিভাবে", "কখন", "কোথায়", "কত", "কোনটি", "কে"],
    "gu": ["શું", "કેમ", "કેવી", "કેવો", "કેવું", "ક્યારે", "ક્યાં", "કેટલું", "કેટલા", "કોણ"],
    "kn": ["ಏನು", "ಏಕೆ", "ಹೇಗೆ", "ಯಾವಾಗ", "ಎಲ್ಲಿ", "ಎಷ್ಟು", "ಯಾವುದು", "ಯಾರು"],
    "ml": ["എന്താണ്", "എന്തുകൊണ്ട്", "എങ്ങനെ", "എപ്പോൾ", "എവിടെ", "എത്ര", "ഏത്", "ആര്"],
    "pa": ["ਕੀ", "ਕਿਉਂ", "ਕਿਵੇਂ", "ਕਦੋਂ", "ਕਿੱਥੇ", "ਕਿੰਨਾ", "ਕਿਹੜਾ", "ਕੌਣ"],
    "or": ["କଣ", "କାହିଁକି", "କିପରି", "କେବେ", "କେଉଁଠି", "କେତେ", "କେଉଁଟି", "କିଏ"],
}
ROMAN_QUESTION_WORDS = ["kay", "kase", "kashi", "kasa", "kiti", "kadhi", "kuthe", "kashala", "ka", "kya", "kaise", "kaisa", "kaisi", "kab", "kahan", "kyun", "kyu", "kitna", "kitni", "kaun", "enna", "eppadi", "eppothu", "enge", "emiti", "ela", "eppudu", "ekkada", "ki", "kivabe", "kokhon", "kothay", "how", "what", "why", "when", "where", "which"]

#: Code-point ranges of scripts.
SCRIPT_RANGES = {
    "devanagari": (0x0900, 0x097F),
    "bengali": (0x0980, 0x09FF),
    "gurmukhi": (0x0A00, 0x0A7F),
    "gujarati": (0x0A80, 0x0AFF),
    "oriya": (0x0B00, 0x0B7F),
    "tamil": (0x0B80, 0x0BFF),
    "telugu": (0x0C00, 0x0C7F),
    "kannada": (0x0C80, 0x0CFF),
    "malayalam": (0x0D00, 0x0D7F),
    "latin": (0x0020, 0x024F),
}

#: Devanagari consonants and their Latin letters, position by position.
DEVANAGARI_LETTERS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरऱलवशषसहळ"
LATIN_LETTERS = "kkggnccjjnttddnttddnppbbmyrrlvssshl"

#: Headline patterns and topic tags, first match counts.
TOPIC_RULES = [
    ("कर्ज|माफी|बँक|वसूली|खाते", "#कर्जमाफी_व_वित्त"),
    ("कांदा|कापूस|सोयाबीन|बाजार|भाव|हमीभाव", "#बाजारभाव_व_शेतीमाल"),
    ("पाऊस|दुष्काळ|हवामान|अवकाळी|पूर", "#हवामान_व_पाऊस"),
    ("निवडणूक|अधिवेशन|सरकार|विधानसभा|मंत्री|भाजप|काँग्रेस|राष्ट्रवादी|शिवसेना|अजित|पवार|ठाकरे|शिंदे|फडणवीस", "#महाराष्ट्र_राजकारण"),
    ("पीक|विमा|शेतकरी|खत|बियाणे|ऊस|द्राक्ष|शेती|कृषी", "#कृषी_व_शेतकरी"),
    ("खेळाडू|क्रिकेट|सामना|विश्वचषक|पांड्या|धोनी|रोहित|विराट|गोलंदाज|फलंदाज|IPL", "#क्रीडा_व_क्रिकेट"),
    ("सिनेमा|चित्रपट|डान्स|व्हिडिओ|अभिनेत्री|अभिनेता|मालिका|कलाकार|गाणी|गाणे", "#मनोरंजन_व_संस्कृती"),
    ("गुन्हा|पोलीस|तपास|अटक|न्यायालय|सरपंच|अपघात|मृत्यू", "#महाराष्ट्र_घडामोडी"),
    ("भरती|नोकरी|परीक्षा|निकाल|स्पर्धा|MPSC|UPSC|विद्यापीठ", "#नोकरी_व_शिक्षण"),
    ("शेअर|गुंतवणूक|म्युच्युअल|सोने|चांदी|अर्थसंकल्प", "#अर्थकारण_व_बाजार"),
    ("आरोग्य|मधुमेह|हृदय|फळ|आहार|फिटनेस|औषध", "#आरोग्य_व_जीवनशैली"),
    ("साहित्य|कविता|पुस्तक|संस्कृती|इतिहास|किल्ला|शिवाजी", "#साहित्य_व_इतिहास"),
    ("मोबाइल|तंत्रज्ञान|अॅप|AI|इंटरनेट|सायबर", "#तंत्रज्ञान"),
]

#: Compounds and their parts; terms and what they stand for in the other script.
COMPOUNDS = {
    "कर्जमाफी": ["कर्ज", "माफी"],
    "कर्जमुक्ती": ["कर्ज", "मुक्ती"],
    "पीकविमा": ["पीक", "विमा"],
    "अतिवृष्टी": ["अति", "वृष्टी"],
    "बाजारभाव": ["बाजार", "भाव"],
    "शेतजमीन": ["शेत", "जमीन"],
    "महावितरण": ["महा", "वितरण"],
    "निवडणूक": ["निवड", "णूक"],
    "अर्थसंकल्प": ["अर्थ", "संकल्प"],
    "जलसंपदा": ["जल", "संपदा"],
    "ग्रामपंचायत": ["ग्राम", "पंचायत"],
}
BILINGUAL = {
    "शेअर": ["stock", "share", "shares", "stocks", "equity"],
    "शेअर्स": ["stock", "share", "shares", "stocks", "equity"],
    "डीमॅट": ["demat", "dmat", "demat-account"],
    "demat": ["डीमॅट", "dmat", "demat"],
    "dmat": ["डीमॅट", "demat"],
    "खाते": ["account", "khate", "acct"],
    "account": ["खाते", "account", "khate"],
    "उघडावे": ["open", "opening", "उघडणे"],
    "उघडणे": ["open", "opening", "उघडावे"],
    "open": ["उघडावे", "उघडणे", "open", "opening"],
    "गुंतवणूक": ["investment", "investing", "invest"],
    "investment": ["गुंतवणूक", "invest", "investment"],
    "invest": ["गुंतवणूक", "invest"],
    "म्युच्युअल": ["mutual", "mutual-fund", "mf"],
    "mutual": ["म्युच्युअल", "mutual"],
    "फंड": ["fund", "funds"],
    "fund": ["फंड", "funds", "fund"],
    "बाजार": ["market", "bazaar", "bazar"],
    "market": ["बाजार", "मार्केट", "market"],
    "ट्रेडिंग": ["trading", "trade"],
    "trading": ["ट्रेडिंग", "trade"],
    "ब्रोकर": ["broker", "brokerage"],
    "broker": ["ब्रोकर", "broker"],
    "एसआयपी": ["sip", "systematic-investment-plan"],
    "sip": ["एसआयपी", "sip", "गुंतवणूक"],
    "आयपीओ": ["ipo", "public-offer"],
    "ipo": ["आयपीओ", "ipo"],
    "सेन्सेक्स": ["sensex"],
    "sensex": ["सेन्सेक्स", "sensex"],
    "निफ्टी": ["nifty"],
    "nifty": ["निफ्टी", "nifty"],
    "बचत": ["saving", "savings"],
    "savings": ["बचत", "savings"],
    "लाभांश": ["dividend"],
    "dividend": ["लाभांश", "dividend"],
    "पोर्टफोलिओ": ["portfolio"],
    "portfolio": ["पोर्टफोलिओ", "portfolio"],
    "सोने": ["gold", "sone"],
    "gold": ["सोने", "gold"],
    "चांदी": ["silver", "chandi"],
    "silver": ["चांदी", "silver"],
    "बँक": ["bank", "banking"],
    "bank": ["बँक", "बँका"],
    "शेतकरी": ["farmer", "farmers", "shetkari", "kisan", "krishi", "agri"],
    "farmer": ["शेतकरी", "shetkari", "kisan"],
    "farmers": ["शेतकरी", "shetkari", "kisan"],
    "shetkari": ["शेतकरी", "farmer", "farmers"],
    "शेती": ["agriculture", "agri", "sheti", "farming"],
    "agri": ["शेती", "कृषी", "sheti"],
    "agriculture": ["शेती", "कृषी", "sheti"],
    "कृषी": ["agriculture", "agri", "krishi"],
    "कर्ज": ["loan", "loans", "karj", "credit", "debt"],
    "कर्जमाफी": ["farmer-loan-waiver", "loan-waiver", "karjamafi", "karj-mafi", "karjmukti"],
    "loan": ["कर्ज", "karj", "finance"],
    "loans": ["कर्ज", "karj"],
    "karj": ["कर्ज", "loan"],
    "karjmafi": ["कर्जमाफी", "karjmafi"],
    "credit": ["कर्ज", "पतपुरवठा", "credit"],
    "माफी": ["waiver", "relief", "mafi", "mukti"],
    "waiver": ["माफी", "कर्जमाफी", "मुक्ती"],
    "पीक": ["crop", "crops", "pik"],
    "विमा": ["insurance", "vima", "bima"],
    "insurance": ["विमा", "vima"],
    "कांदा": ["onion", "kanda"],
    "onion": ["कांदा", "kanda"],
    "कापूस": ["cotton", "kapus"],
    "cotton": ["कापूस", "kapus"],
    "सोयाबीन": ["soybean", "soya"],
    "soybean": ["सोयाबीन", "soya"],
    "हवामान": ["weather", "havaman", "forecast", "monsoon"],
    "weather": ["हवामान", "havaman"],
    "havaman": ["हवामान", "weather"],
    "दुष्काळ": ["drought", "dushkal"],
    "drought": ["दुष्काळ", "dushkal"],
    "पाऊस": ["rain", "monsoon", "rainfall"],
    "rain": ["पाऊस", "rain"],
    "बाजारभाव": ["mandi", "rates", "price", "bazarbhav"],
    "भाव": ["rate", "price", "bhav"],
    "सातबारा": ["satbara", "7-12", "7/12", "utara"],
    "satbara": ["सातबारा", "७/१२", "utara"],
    "उतारा": ["utara", "extract"],
    "utara": ["उतारा", "utara"],
    "फेरफार": ["ferfar", "mutation"],
    "ferfar": ["फेरफार", "ferfar"],
    "लाडकी": ["ladki", "ladaki"],
    "बहीण": ["bahin"],
    "ladki": ["लाडकी", "ladki"],
    "bahin": ["बहीण", "bahin"],
    "योजना": ["scheme", "yojana", "initiative"],
    "yojana": ["योजना", "scheme"],
    "scheme": ["योजना", "yojana"],
    "अनुदान": ["subsidy", "anudan", "grant"],
    "subsidy": ["अनुदान", "subsidy"],
    "सरकार": ["govt", "government", "sarkar"],
    "sarkar": ["सरकार", "sarkar"],
    "शासन": ["shasan", "govt", "government"],
    "shasan": ["शासन", "shasan"],
    "निर्णय": ["nirnay", "decision", "gr"],
    "gr": ["शासन निर्णय", "gr"],
    "निवडणूक": ["election", "nivadnuk", "poll"],
    "अर्थसंकल्प": ["budget", "arthasankalp"],
    "budget": ["अर्थसंकल्प", "budget"],
    "भरती": ["bharti", "recruitment"],
    "bharti": ["भरती", "recruitment"],
    "पोलीस": ["police"],
    "police": ["पोलीस", "police"],
    "तलाठी": ["talathi"],
    "talathi": ["तलाठी", "talathi"],
    "नोकरी": ["naukri", "job", "jobs"],
    "job": ["नोकरी", "job"],
    "jobs": ["नोकरी", "jobs"],
    "mpsc": ["MPSC", "एमपीएससी"],
}

#: Words that a search ignores beside others.
STOPWORDS = ["कसे", "कसा", "कशी", "काय", "का", "केव्हा", "कधी", "कुठे", "कोठे", "कोण", "कोणाला", "कशासाठी", "कशाने", "किती", "करावे", "करावा", "करावी", "करणे", "करणार", "करा", "होणार", "होते", "होता", "होती", "आहे", "आहेत", "नाही", "नाहीत", "असेल", "असावे", "जाणून", "घ्या", "द्या", "आपण", "मी", "तू", "तुम्ही", "त्यांचे", "त्यांना", "हे", "तो", "ती", "ते", "या", "वर", "खाली", "येथे", "तेथे", "मध्ये", "साठी", "पासून", "पर्यंत", "बद्दल", "विषयक"]

#: Display names of domains.
DOMAIN_NAMES = {
    "agrowon.esakal.com": "ॲग्रोवन (Agrowon)",
    "esakal.com": "सकाळ (Esakal)",
    "www.esakal.com": "सकाळ (Esakal)",
    "loksatta.com": "लोकसत्ता (Loksatta)",
    "www.loksatta.com": "लोकसत्ता (Loksatta)",
    "maharashtratimes.com": "महाराष्ट्र टाइम्स (Maharashtra Times)",
    "deshdoot.com": "देशदूत (Deshdoot)",
    "saamana.com": "सामना (Saamana)",
    "lokmat.com": "लोकमत (Lokmat)",
    "www.lokmat.com": "लोकमत (Lokmat)",
    "tv9marathi.com": "टीव्ही९ मराठी (TV9 Marathi)",
    "www.tv9marathi.com": "टीव्ही९ मराठी (TV9 Marathi)",
    "sarkarnama.esakal.com": "सरकारनामा (Sarkarnama)",
    "pudhari.news": "पुढारी (Pudhari)",
    "tarunbharat.net": "तरुण भारत (Tarun Bharat)",
    "navarashtra.com": "नवराष्ट्र (Navarashtra)",
    "news18marathi.com": "न्यूज१८ लोकमत (News18 Marathi)",
    "mr.wikipedia.org": "मराठी विकिपीडिया (Wikipedia)",
    "paisamarg.com": "पैसामार्ग (PaisaMarg)",
    "arthasakshar.com": "अर्थसाक्षर (ArthaSakshar)",
    "www.arthasakshar.com": "अर्थसाक्षर (ArthaSakshar)",
    "prahaar.in": "प्रहार (Prahaar)",
    "www.prahaar.in": "प्रहार (Prahaar)",
    "maayboli.com": "मायबोली (Maayboli)",
    "madhurasrecipe.com": "मधुराज रेसिपी (MadhurasRecipe)",
}

#: Month names.
MONTHS = ["जानेवारी", "फेब्रुवारी", "मार्च", "एप्रिल", "मे", "जून", "जुलै", "ऑगस्ट", "सप्टेंबर", "ऑक्टोबर", "नोव्हेंबर", "डिसेंबर"]

#: Curated suggestions (native phrase, English phrase, triggers).
SUGGESTIONS = [
    ("शेअर बाजार डीमॅट खाते कसे उघडावे", "demat account open process in marathi", ["demat", "dmat", "demat account", "डीमॅट", "खाते", "open demat", "शेअर बाजार"]),
    ("डीमॅट खाते म्हणजे काय (What is Demat Account)", "what is demat account in marathi", ["demat", "dmat", "डीमॅट", "what is demat"]),
    ("सर्वोत्तम डीमॅट खाते ॲप्स (Best Demat Apps)", "best demat account apps in india", ["demat", "dmat", "apps", "ॲप्स", "best demat"]),
    ("शेअर बाजार मूलभूत माहिती मराठीत", "share market basics in marathi for beginners", ["share", "stock", "share market", "stock market", "शेअर बाजार", "शेअर"]),
    ("शेअर बाजारात गुंतवणूक कशी करावी", "how to invest in share market marathi", ["invest", "investment", "गुंतवणूक", "share", "stock", "शेअर बाजार"]),
    ("म्युच्युअल फंड म्हणजे काय आणि प्रकार", "what is mutual fund in marathi", ["mutual", "fund", "mf", "म्युच्युअल", "फंड", "म्युच्युअल फंड"]),
    ("एसआयपी (SIP) गुंतवणूक आणि फायदे", "sip investment benefits in marathi", ["sip", "एसआयपी", "sip calculator", "mutual fund", "गुंतवणूक"]),
    ("निफ्टी आणि सेन्सेक्स म्हणजे काय", "nifty and sensex meaning in marathi", ["nifty", "sensex", "निफ्टी", "सेन्सेक्स", "share market"]),
    ("आयपीओ (IPO) म्हणजे काय आणि कसा भरावा", "how to apply ipo online in marathi", ["ipo", "आयपीओ", "ipo allotment", "शेअर"]),
    ("सोने आणि चांदीचे आजचे ताजे भाव", "today gold rate in maharashtra (सोने भाव)", ["gold", "sone", "silver", "chandi", "सोने", "चांदी", "gold rate"]),
    ("बँक मुदत ठेव (FD) व्याजदर २०२६", "fixed deposit interest rates in marathi", ["fd", "fixed deposit", "bank", "बँक", "व्याजदर", "मुदत ठेव"]),
    ("गृहकर्ज (Home Loan) व्याजदर तुलना", "home loan interest rates comparison", ["home loan", "loan", "karj", "कर्ज", "गृहकर्ज"]),
    ("पर्सनल लोन व्याजदर आणि पात्रता", "personal loan eligibility and interest rates", ["personal loan", "loan", "karj", "कर्ज"]),
    ("शेतकरी कर्जमाफी यादी २०२६", "shetkari karjmafi yojana list 2026", ["shetkari", "karjmafi", "farmer loan", "loan waiver", "कर्जमाफी", "शेतकरी"]),
    ("शेतकरी कर्जमाफी शासन निर्णय (GR)", "shetkari karjmafi shasan nirnay gr", ["shetkari", "karjmafi", "gr", "शासन निर्णय", "कर्जमाफी"]),
    ("नमो शेतकरी महासन्मान निधी योजना हप्ता", "namo shetkari yojana installment status", ["namo shetkari", "pm kisan", "नमो शेतकरी", "हप्ता", "farmer scheme"]),
    ("पीक विमा नुकसान भरपाई नवीन यादी", "pik vima nuksan bharpai yadi 2026", ["pik vima", "crop insurance", "vima", "पीक विमा", "नुकसान भरपाई"]),
    ("कांदा बाजारभाव आजचे थेट भाव", "kanda bajar bhav today lasalgaon", ["kanda", "onion", "market", "bajar bhav", "कांदा", "लासलगाव"]),
    ("सोयाबीन भाव आजचे प्रमुख बाजार समित्या", "soybean bajar bhav today maharashtra", ["soybean", "soya", "सोयाबीन", "बाजारभाव"]),
    ("कापूस हमीभाव २०२६ दर क्विंटल", "cotton kapus bhav today maharashtra", ["kapus", "cotton", "कापूस", "हमीभाव"]),
    ("हवामान अंदाज पंजाबराव डख थेट", "havaman andaj punjabrao dakh today", ["havaman", "weather", "paus", "rain", "dakh", "हवामान", "पंजाबराव", "पाऊस"]),
    ("विहिरीसाठी अनुदान योजना अर्ज प्रक्रिया", "vhir anudan yojana online application", ["vhir", "well subsidy", "anudan", "विहीर", "अनुदान"]),
    ("ठिबक सिंचन अनुदान योजना ८० टक्के", "drip irrigation subsidy maharashtra", ["drip", "thibak", "ठिबक सिंचन", "अनुदान"]),
    ("सौर कृषी पंप योजना अर्ज महावितरण", "solar krushi pump yojana mahavitaran", ["solar pump", "krushi pump", "सौर पंप", "महावितरण"]),
    ("दुष्काळ जाहीर तालुके यादी महाराष्ट्र", "drought affected talukas list maharashtra", ["drought", "dushkal", "दुष्काळ", "तालुके"]),
    ("लाडकी बहीण योजना अर्ज प्रक्रिया", "ladki bahin yojana online application form", ["ladki", "bahin", "ladaki", "लाडकी", "बहीण", "लाडकी बहीण"]),
    ("लाडकी बहीण योजना लाभार्थी नवीन यादी २०२६", "ladki bahin yojana beneficiary list 2026", ["ladki", "bahin", "list", "यादी", "लाभार्थी", "लाडकी बहीण"]),
    ("लाडकी बहीण योजना हप्ता कधी जमा होणार", "ladki bahin yojana installment status date", ["ladki", "bahin", "installment", "हप्ता", "लाडकी बहीण"]),
    ("लाडकी बहीण योजना e-KYC कशी करावी", "ladki bahin yojana ekyc update process", ["ladki", "ekyc", "kyc", "लाडकी", "ईकेवायसी"]),
    ("महाराष्ट्र शासन निर्णय (GR) संकेतस्थळ", "maharashtra shasan nirnay gr official portal", ["shasan nirnay", "gr", "government order", "शासन निर्णय", "जीआर"]),
    ("लेक लाडकी योजना अर्ज व कागदपत्रे", "lek ladki yojana documents and eligibility", ["lek ladki", "लेक लाडकी", "योजना"]),
    ("नवीन रेशन कार्ड ऑनलाइन अर्ज महाराष्ट्र", "ration card online application maharashtra", ["ration card", "रेशन कार्ड", "नवीन रेशन"]),
    ("आयुष्मान भारत कार्ड डाउनलोड कसे करावे", "ayushman bharat card download online", ["ayushman", "health card", "आयुष्मान भारत"]),
    ("संजय गांधी निराधार योजना पात्रता", "sanjay gandhi niradhar yojana documents", ["niradhar", "sanjay gandhi", "निराधार योजना"]),
    ("घरकुल योजना नवीन यादी २०२६", "gharkul yojana beneficiary list 2026", ["gharkul", "pm awas", "घरकुल", "आवास योजना"]),
    ("अण्णासाहेब पाटील आर्थिक विकास महामंडळ कर्ज", "annasaheb patil loan yojana application", ["annasaheb patil", "अण्णासाहेब पाटील", "कर्ज"]),
    ("७/१२ उतारा ऑनलाइन कसा काढायचा", "satbara utara online download mahabhumi", ["satbara", "7/12", "7 12", "utara", "सातबारा", "उतारा"]),
    ("डिजिटल सातबारा स्वाक्षरी डाउनलोड महाभूमी", "digital 7/12 signature mahabhumi portal", ["digital 7/12", "digital satbara", "डिजिटल सातबारा", "महाभूमी"]),
    ("८-अ उतारा ऑनलाइन कसा पाहावा", "8a utara online download maharashtra", ["8a", "8 a", "८-अ", "उतारा"]),
    ("फेरफार नोंद कशी तपासावी महाभूमी", "ferfar nond online status maharashtra", ["ferfar", "mutation", "फेरफार", "नोंद"]),
    ("वारस नोंद कशी करावी नियम व कागदपत्रे", "varas nond process in revenue department", ["varas", "वारस नोंद", "महसूल"]),
    ("जमिनीचा नकाशा ऑनलाइन भूमी अभिलेख", "land map bhunaksha maharashtra online", ["bhunaksha", "map", "नकाशा", "जमीन"]),
    ("तुकडेबंदी कायदा नवीन नियम महाराष्ट्र", "tukdebandi new rules maharashtra 2026", ["tukdebandi", "तुकडेबंदी"]),
    ("MPSC राज्यसेवा पूर्व परीक्षा अभ्यासक्रम", "mpsc rajyaseva syllabus and pattern 2026", ["mpsc", "rajyaseva", "syllabus", "अभ्यासक्रम", "एमपीएससी"]),
    ("MPSC संयुक्त गट ब व क जाहिरात", "mpsc combine group b and c notification", ["mpsc combine", "संयुक्त गट", "mpsc"]),
    ("MPSC हॉल तिकीट डाऊनलोड लिंक", "mpsc hall ticket admit card download", ["mpsc hall ticket", "admit card", "हॉल तिकीट", "mpsc"]),
    ("महाराष्ट्र पोलीस भरती शारीरिक चाचणी नियम", "police bharti 2026 physical test rules", ["police bharti", "police", "पोलीस भरती"]),
    ("महाराष्ट्र तलाठी भरती अंतिम निकाल", "talathi bharti final result merit list", ["talathi bharti", "talathi", "तलाठी भरती"]),
    ("जिल्हा परिषद भरती निकाल व गुणवत्ता यादी", "zp bharti merit list 2026 maharashtra", ["zp bharti", "zp", "जिल्हा परिषद भरती"]),
    ("चालू घडामोडी २०२६ स्पर्धा परीक्षा नोट्स", "current affairs 2026 marathi notes for mpsc", ["current affairs", "चालू घडामोडी", "mpsc notes"]),
    ("छत्रपती शिवाजी महाराज इतिहास व किल्ले", "chhatrapati shivaji maharaj history and forts", ["shivaji", "chhatrapati", "शिवाजी महाराज", "किल्ले"]),
    ("छत्रपती संभाजी महाराज पराक्रम व चरित्र", "chhatrapati sambhaji maharaj history", ["sambhaji", "संभाजी महाराज"]),
    ("संत तुकाराम महाराज अभंग गाथा भावार्थ", "sant tukaram abhang gatha meaning", ["tukaram", "abhang", "तुकाराम महाराज", "अभंग"]),
    ("संत ज्ञानेश्वर ज्ञानेश्वरी पारायण अध्याय", "sant dnyaneshwar dnyaneshwari marathi", ["dnyaneshwar", "dnyaneshwari", "ज्ञानेश्वरी"]),
    ("डॉ. बाबासाहेब आंबेडकर विचार व ग्रंथ", "dr babasaheb ambedkar books and thoughts", ["ambedkar", "babasaheb", "आंबेडकर"]),
]

#: Directory sections (id, native title, English title, categories).
DIRECTORY = [
    ("news", "बातम्या आणि वृत्त माध्यमे", "News & Media", ["News & Media"]),
    ("finance_jobs", "अर्थकारण, नोकरी आणि योजना", "Finance, Jobs & Schemes", ["Finance & Career"]),
    ("agriculture", "कृषी आणि शेती मार्गदर्शन", "Agriculture & Farming", ["Agriculture"]),
    ("knowledge_wiki", "ज्ञानकोश आणि अधिकृत शब्दकोश", "Encyclopedia & Lexicons", ["Knowledge & Wiki", "Government"]),
    ("literature_forums", "साहित्य, कविता आणि कट्टा", "Literature, Poetry & Forums", ["Community & Literature"]),
    ("culture_history", "इतिहास, संस्कृती आणि विचार", "History, Culture & Ideas", ["Culture & History"]),
    ("lifestyle_cuisine", "पाककला, सण आणि पंचांग", "Cuisine, Lifestyle & Calendar", ["Lifestyle & Cooking", "Health & Lifestyle"]),
    ("tech_blogs", "तंत्रज्ञान, माहिती आणि ब्लॉग्स", "Tech, Guides & Blogs", ["Blogs & Technology", "Blogs & General"]),
]

#: Domains that discovery skips.
IGNORED_DOMAINS = ["facebook.com", "twitter.com", "x.com", "youtube.com", "instagram.com", "whatsapp.com", "api.whatsapp.com", "play.google.com", "apps.apple.com", "google.com", "news.google.com", "linkedin.com", "pinterest.com", "telegram.me", "t.me", "amzn.to", "amazon.in", "amazon.com", "wordpress.org", "blogger.com", "wpvip.com", "quintype.com", "timesinternet.in", "timescontent.com", "rngfoundation.com", "myvi.in", "w3.org", "schema.org", "cloudflare.com"]

#: Answer cards in order (title, keywords).
ANSWER_CARDS = [
    ("म्युच्युअल फंड व शेअर बाजार: पायाभूत मार्गदर्शक", ["शेअर बाजार", "शेअरबाजार", "म्युच्युअल फंड", "म्युच्युअल", "एसआयपी", "sip", "share market", "mutual fund", "डीमॅट", "डिमॅट", "गुंतवणूक"]),
    ("मुख्यमंत्री माझी लाडकी बहीण योजना — अधिकृत माहिती", ["लाडकी बहीण", "लाडकी बहिन", "ladki bahin", "लाडक्या बहिणी"]),
    ("महाराष्ट्र शासन शेतकरी कर्जमाफी व पीक कर्ज दिलासा", ["कर्जमाफी", "कर्ज माफी", "karjmafi", "शेतकरी कर्ज", "पीक कर्ज"]),
    ("महाराष्ट्र प्रमुख बाजार समित्या: शेतमाल बाजारभाव संदर्भ", ["कांदा भाव", "कांदा बाजार", "सोयाबीन भाव", "कापूस भाव", "कापूस हमीभाव", "बाजारभाव", "बाजार भाव", "मंडी भाव", "लासलगाव कांदा"]),
    ("महाराष्ट्र भूमी अभिलेख: डिजिटल सातबारा व महसूल संज्ञा", ["सातबारा", "७/१२", "फेरफार", "८-अ", "भोगवटादार", "वारस नोंद", "bhulekh", "digitalsatbara"]),
    ("नमो शेतकरी महासन्मान निधी योजना — शासन निर्णय व निकष", ["नमो शेतकरी", "namo shetkari", "शेतकरी महासन्मान"]),
    ("महाराष्ट्र लोकसेवा आयोग (MPSC) व भरती परीक्षा संदर्भ", ["mpsc", "एमपीएससी", "राज्यसेवा", "संयुक्त पूर्व", "तलाठी भरती", "पोलीस भरती"]),
    ("महाराष्ट्र शासन अधिकृत शासन निर्णय व परिपत्रके", ["शासन निर्णय", "जीआर", "gr", "परिपत्रक", "अधिसूचना"]),
]

#: Elapsed time in words.
ELAPSED = {"today": "आज", "now": "आत्ताच", "new": "आत्ताच प्रसिद्ध", "minutes": "मिनिटांपूर्वी", "hours": "तासांपूर्वी", "yesterday": "काल", "days": "दिवसांपूर्वी"}
#: Reading times, and the rest of a feed card's text.
READING = ("१ मिनिट वाचन", "२ मिनिटे वाचन")
CARD_TEXT = "... सविस्तर वृत्त आणि माहिती वाचण्यासाठी क्लिक करा."
#: Tags of the feed for candidates and for reporters, first match counts.
EXAM_RULES = [
    ("शासन|निर्णय|योजना|मंत्रिमंडळ|न्यायालय|कायदा|विधानसभा|GR|आरक्षण|आयोग|MPSC|UPSC|घटना|कलम|सर्वोच्च|अधिनियम|धोरण", "📜 MPSC GS-2: शासन निर्णय व राज्यव्यवस्था"),
    ("कर्ज|माफी|बँक|अर्थसंकल्प|शेअर|बाजार|भाव|कांदा|कापूस|सोयाबीन|पीक|विमा|शेतकरी|कृषी|जीडीपी|गुंतवणूक|उद्योग|सिंचन|धरण|ऊर्जा|अर्थकारण", "🌾 MPSC GS-3: कृषी व अर्थव्यवस्था"),
    ("इतिहास|भूगोल|संस्कृती|किल्ला|शिवाजी|नदी|पाऊस|हवामान|वारसा|साहित्य|पुरस्कार|अवकाळी", "🏛️ MPSC GS-1: इतिहास, भूगोल व संस्कृती"),
    ("विज्ञान|तंत्रज्ञान|ISRO|उपग्रह|AI|पर्यावरण|प्रदूषण|जैवविविधता|रोग|आरोग्य|लस", "⚡ MPSC GS-3: विज्ञान व तंत्रज्ञान"),
]
EXAM_OTHER = "📌 MPSC: राज्य चालू घडामोडी २०२६"
DESK_RULES = [
    ("पुणे|मुंबई|नाशिक|नागपूर|संभाजीनगर|कोल्हापूर|ठाणे|सोलापूर|अमरावती|जळगाव|नांदेड|परभणी|सातारा|सांगली|बीड|लातूर|अहिल्यानगर|धाराशिव", "📍 प्रादेशिक जिल्हा रडार"),
    ("मंत्रालय|सरकार|विधानसभा|मुख्यमंत्री|मंत्री|अधिवेशन|भाजप|काँग्रेस|राष्ट्रवादी|शिवसेना|अजित|पवार|शिंदे|ठाकरे|फडणवीस|निवडणूक", "🏛️ मंत्रालय व राजकीय वायर"),
    ("शेतकरी|पीक|बाजार|भाव|कांदा|कापूस|कर्ज|हमीभाव|दुष्काळ|पाऊस|बाजार समिती", "🚜 कृषी व ग्रामीण वार्ता"),
    ("पोलीस|गुन्हा|तपास|अटक|न्यायालय|सीबीआय|ईडी|आरोप|तक्रार|सरपंच|अपघात", "⚖️ कायदेशीर व क्राईम डेस्क"),
]
DESK_OTHER = "🚨 थेट ब्रेकिंग न्यूज वायर"
#: Title characters of which a feed title has one; words that the exam mode leaves out.
FEED_LETTERS = ["ा", "े", "ी", "क"]
EXAM_BLOCKED = ["डान्स", "राशी", "भविष्य", "सिनेमा", "अभिनेत्री", "अभिनेता", "गाडी", "कपडे"]
#: By mode and topic (None: any other), what title, category or URL must hold.
FEED_TOPICS: dict[tuple[str, str | None], dict[str, list[str]]] = {
    ("mpsc", "gs1"): {"title": ["इतिहास", "भूगोल", "पाऊस", "हवामान", "किल्ला", "संस्कृती"]},
    ("mpsc", "gs2"): {"title": ["शासन", "योजना", "निर्णय", "मंत्रालय", "कायदा", "आरक्षण", "न्यायालय"]},
    ("mpsc", "gr"): {"title": ["शासन", "योजना", "निर्णय", "मंत्रालय", "कायदा", "आरक्षण", "न्यायालय"]},
    ("mpsc", "gs3"): {"title": ["अर्थ", "बँक", "शेती", "शेतक", "पीक", "कर्ज", "बाजार", "तंत्रज्ञान"]},
    ("mpsc", None): {"title": ["शासन", "योजना", "निर्णय", "शेतक", "बँक", "कर्ज", "पाऊस", "हवामान", "महाराष्ट्र", "परीक्षा"]},
    ("reporter", "politics"): {"title": ["सरकार", "मंत्रालय", "अधिवेशन", "निवडणूक", "पक्ष", "आरोप"]},
    ("reporter", "rural"): {"title": ["शेतक", "कांदा", "बाजार", "पाऊस", "हमीभाव", "पीक"]},
    ("reporter", "crime"): {"title": ["पोलीस", "गुन्हा", "तपास", "अटक", "न्यायालय"]},
    ("reporter", "regional"): {"title": ["पुणे", "नाशिक", "नागपूर", "संभाजीनगर", "जळगाव", "परभणी", "कोल्हापूर"]},
    ("general", "agriculture"): {"category": ["Agri"], "title": ["शेतक", "पीक", "कर्ज"]},
    ("general", "news"): {"category": ["News"], "title": ["अधिवेशन", "सरकार", "पोलीस"]},
    ("general", "finance"): {"category": ["Finance"], "title": ["बँक", "पैसा", "बाजार"]},
    ("general", "tech"): {"category": ["Tech"], "url": ["gadget"], "title": ["मोबाइल"]},
    ("general", "culture"): {"category": ["Culture", "Literature"], "title": ["साहित्य"]},
}
#: Words of a query, what follows up on them.
RELATED = [
    (["शेतक", "कर्ज", "शेती", "farmer", "loan"], ["शेतकरी कर्जमाफी यादी २०२६", "पीक विमा नुकसान भरपाई अर्ज", "अतिवृष्टी शेतकरी मदत शासन निर्णय", "जिल्हा मध्यवर्ती बँक पीक कर्ज नियम", "शेतकरी सन्मान निधी योजना हप्ता", "कांदा व कापूस बाजारभाव आजचे दर"]),
    (["कांदा", "बाजार", "भाव", "दर"], ["कांदा बाजारभाव आजचे ताजे दर", "लासलगाव कांदा मार्केट लिलाव", "कांदा निर्यात अनुदान शासन निर्णय", "सोयाबीन व कापूस बाजारभाव"]),
    (["शेअर", "पैसा", "गुंतवणूक", "फंड", "म्युच्युअल"], ["शेअर बाजार मराठी सविस्तर माहिती", "म्युच्युअल फंड गुंतवणूक कशी करावी", "एसआयपी (SIP) मराठी कॅल्क्युलेटर", "सर्वोत्कृष्ट सरकारी बचत योजना"]),
    (["हवामान", "पाऊस", "मान्सून"], ["महाराष्ट्र हवामान अंदाज आजचा", "पंजाबराव डख हवामान अंदाज", "पुढील २४ तासांत पावसाचा इशारा"]),
]
RELATED_ENDINGS = ["शासन निर्णय GR", "ताज्या बातम्या २०२६", "सविस्तर नियम व पद्धत", "अधिकृत पोर्टल"]
#: Words of a query, words of a page, and what both together add to a score.
ENTITY_BOOSTS = [
    (["demat", "डीमॅट"], ["demat", "डीमॅट"], 0.40),
    (["म्युच्युअल", "mutual"], ["म्युच्युअल", "mutual"], 0.35),
    (["कर्जमाफी", "karjmafi"], ["कर्जमाफी", "karjmafi"], 0.35),
    (["लाडकी", "ladki"], ["लाडकी", "ladki"], 0.35),
    (["सातबारा", "satbara", "7/12"], ["सातबारा", "satbara", "7/12"], 0.35),
    (["शेअर बाजार"], ["शेअर बाजार", "share market", "stock market"], 0.25),
    (["शेअर", "बाजार", "डीमॅट", "म्युच्युअल", "गुंतवणूक"], ["सोशल मीडिया"], -0.35),
]
FRESH_WORDS = ["आज", "ताजा", "ताज्या", "२०२६", "नवीन", "आता"]
#: Categories, words in the domain, words of the page, and the snippet they give; first match counts.
SNIPPETS = [
    (["finance"], ["arthasakshar", "paisa"], ["शेअर", "डीमॅट", "म्युच्युअल", "गुंतवणूक", "फंड", "बँक", "demat", "share", "stock", "invest", "mutual"], "शेअर बाजार, म्युच्युअल फंड, डीमॅट खाते व वैयक्तिक वित्त विषयक सविस्तर मराठी मार्गदर्शक."),
    (["mpsc"], [], ["mpsc", "भरती", "पोलीस", "तलाठी"], "स्पर्धा परीक्षा, भरती जाहिरात, अभ्यासक्रम व चालू घडामोडी अधिकृत माहिती."),
    (["agri"], [], ["शेतकरी", "पीक", "कांदा", "बाजारभाव", "कर्जमाफी", "हवामान"], "शेती, शेतकरी, पीक विमा, बाजारभाव व शासकीय योजना संबंधित अधिकृत मराठी वृत्त व सविस्तर माहिती."),
    (["gov"], [], ["लाडकी बहीण", "शासन निर्णय", "gr", "योजना"], "शासकीय योजना, शासन निर्णय (GR), नियम व अधिकृत पोर्टल माहिती."),
]
SNIPPET_OTHER = "अधिकृत मराठी वृत्त, घडामोडी व सविस्तर माहिती."

#: Words that make a suggestion a how-to or a comparison when intents are voted on.
HOWTO_WORDS = ["कसे", "कसा", "कशी", "how to", "steps", "पद्धत", "तरीका", "अर्ज", "process"]
VERSUS_WORDS = [" vs ", "विरुद्ध", "बनाम", "तुलना", "compare", "फरक", "difference"]
