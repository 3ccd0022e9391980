"""The built-in dictionary of identifier names (fixed values).

One entry per personal-data type: category, severity, and the patterns of its names in order, each with a confidence (high, medium, low).
Patterns ignore case and may match anywhere unless anchored.
"""

from __future__ import annotations

DICTIONARY: list[tuple[str, str, str, list[tuple[str, str]]]] = [
    ("email", "contact_info", "high", [(r"^e[-_]?mail(_addr(ess)?)?$", "high"), (r"^(user|customer|client|member|employee)[-_]?email$", "high"), (r"email", "medium")]),
    ("phone_number", "contact_info", "high", [(r"^phone[-_]?(number|num|no)?$", "high"), (r"^(mobile|cell|tel|telephone)[-_]?(number|num|no)?$", "high"), (r"(?:^|[-_])(phone|mobile|cell|tel(?:ephone)?)(?:[-_]|$)", "medium")]),
    ("address", "contact_info", "high", [(r"^(street|home|mailing|billing|shipping)[-_]?addr(ess)?$", "high"), (r"^address[-_]?(line[-_]?[12])?$", "high"), (r"^postal[-_]?(code|zip)$", "medium")]),
    ("full_name", "personal_attribute", "high", [(r"^full[-_]?name$", "high"), (r"^(first|last|given|family|sur)[-_]?name$", "high"), (r"^(user|customer|client|display)[-_]?name$", "medium"), (r"^name$", "low")]),
    ("date_of_birth", "personal_attribute", "medium", [(r"^(date[-_]?of[-_]?birth|dob|birth[-_]?date|birthday)$", "high")]),
    ("gender", "personal_attribute", "low", [(r"^gender$", "high"), (r"^sex$", "medium")]),
    ("national_id", "government_id", "critical", [(r"^(ssn|social[-_]?security[-_]?(number|num|no)?)$", "high"), (r"^(national[-_]?id|resident[-_]?id)$", "high")]),
    ("passport_number", "personal_attribute", "critical", [(r"^passport[-_]?(number|num|no|id)?$", "high")]),
    ("ip_address", "network_identifier", "medium", [(r"^ip[-_]?(addr(ess)?)?$", "high"), (r"^(client|remote|source|src|user)[-_]?ip$", "high"), (r"^ip[-_]?v[46]$", "high"), (r"ip[-_]?addr", "medium")]),
    ("credit_card", "financial_info", "critical", [(r"^(credit[-_]?card|cc)[-_]?(number|num|no)?$", "high"), (r"^card[-_]?number$", "high"), (r"^pan$", "medium")]),
    ("bank_account", "financial_info", "critical", [(r"^(bank[-_]?)?account[-_]?(number|num|no)?$", "high")]),
    ("salary", "financial_info", "high", [(r"^(salary|wage|income|compensation|pay[-_]?rate)$", "high")]),
    ("password", "auth_credential", "critical", [(r"^(password|passwd|pass[-_]?word|pwd|secret)$", "high"), (r"^(password|passwd)[-_]?hash$", "medium")]),
    ("auth_token", "auth_credential", "critical", [(r"^(auth[-_]?)?token$", "high"), (r"^(access|refresh|bearer|session)[-_]?token$", "high"), (r"^(jwt|oauth)[-_]?token$", "high")]),
    ("api_key", "auth_credential", "critical", [(r"^api[-_]?key$", "high"), (r"^(secret|private)[-_]?key$", "high"), (r"^(aws|gcp|azure)[-_]?(access[-_]?)?key$", "high")]),
    ("health_data", "health_info", "critical", [(r"^(health|medical)[-_]?(data|info|record|condition|history)$", "high"), (r"^(diagnosis|treatment|medication|allergy|blood[-_]?type)$", "high")]),
    ("medical_record", "health_info", "critical", [(r"^(medical|health)[-_]?record[-_]?(number|num|no|id)?$", "high"), (r"^(mrn|patient[-_]?id)$", "high")]),
    ("postal_code", "contact_info", "medium", [(r"^(postal|zip)[-_]?code$", "high"), (r"^(postcode|zip)$", "high")]),
    ("fax", "contact_info", "medium", [(r"^fax[-_]?(number|num|no)?$", "high")]),
    ("first_name", "personal_attribute", "high", [(r"^first[-_]?name$", "high"), (r"^given[-_]?name$", "high"), (r"^fname$", "medium")]),
    ("last_name", "personal_attribute", "high", [(r"^last[-_]?name$", "high"), (r"^(family|sur)[-_]?name$", "high"), (r"^lname$", "medium")]),
    ("nationality", "personal_attribute", "medium", [(r"^nationality$", "high"), (r"^citizenship$", "high")]),
    ("ethnicity", "personal_attribute", "high", [(r"^(ethnicity|race|ethnic[-_]?group)$", "high")]),
    ("drivers_license", "government_id", "critical", [(r"^driver('?s)?[-_]?licen[sc]e[-_]?(number|num|no|id)?$", "high"), (r"^(dl|driving)[-_]?(license|licence)$", "high")]),
    ("tax_id", "government_id", "critical", [(r"^tax[-_]?(id|number|num|no|identification)$", "high"), (r"^(tin|vat[-_]?number|ein|itin)$", "high")]),
    ("voter_id", "government_id", "critical", [(r"^voter[-_]?(id|card|number)$", "high")]),
    ("my_number", "government_id", "critical", [(r"^my[-_]?number$", "high"), (r"^(kojin[-_]?bango|individual[-_]?number)$", "high"), (r"^(juminhyo|juki)[-_]?(code|number|no)?$", "medium")]),
    ("iban", "financial_info", "critical", [(r"^iban$", "high"), (r"^iban[-_]?(number|no|code)$", "high")]),
    ("bsn", "government_id", "critical", [(r"^bsn$", "high"), (r"^burger[-_]?service[-_]?nummer$", "high")]),
    ("nhs", "government_id", "critical", [(r"^nhs[-_]?(number|num|no|id)?$", "high"), (r"^ni[-_]?(number|no)$", "high")]),
    ("bank_routing_number", "financial_info", "critical", [(r"^routing[-_]?(number|num|no)$", "high"), (r"^(aba|sort)[-_]?(code|number)$", "high")]),
    ("swift_code", "financial_info", "high", [(r"^(swift|bic)[-_]?(code|number)?$", "high")]),
    ("crypto_wallet", "financial_info", "high", [(r"^(crypto|bitcoin|btc|eth|wallet)[-_]?(addr(ess)?|id)$", "high")]),
    ("insurance_id", "financial_info", "high", [(r"^insurance[-_]?(id|number|num|no|policy)$", "high"), (r"^policy[-_]?(number|num|no|id)$", "high")]),
    ("private_key", "auth_credential", "critical", [(r"^private[-_]?key$", "high"), (r"^(rsa|ssh|pgp|gpg)[-_]?(private[-_]?)?key$", "high")]),
    ("secret_key", "auth_credential", "critical", [(r"^secret[-_]?key$", "high"), (r"^(encryption|signing|hmac)[-_]?key$", "high"), (r"^client[-_]?secret$", "high")]),
    ("diagnosis", "health_info", "critical", [(r"^diagnosis$", "high"), (r"^(medical[-_]?)?condition$", "medium")]),
    ("prescription", "health_info", "critical", [(r"^(prescription|medication|drug[-_]?name)$", "high")]),
    ("patient_id", "health_info", "critical", [(r"^patient[-_]?(id|number|num|no)$", "high"), (r"^(mrn|medical[-_]?record[-_]?number)$", "high")]),
    ("insurance_claim_id", "health_info", "critical", [(r"^(insurance[-_]?)?claim[-_]?(id|number|num|no)$", "high"), (r"^(member[-_]?id|subscriber[-_]?id|group[-_]?number)$", "high")]),
    ("lab_result", "health_info", "critical", [(r"^(lab[-_]?result|test[-_]?result|pathology[-_]?report)$", "high"), (r"^(blood[-_]?type|hba1c|cholesterol|glucose[-_]?level)$", "high")]),
    ("card_token", "financial_info", "high", [(r"^(card[-_]?token|payment[-_]?token|stripe[-_]?token)$", "high"), (r"^(tokenized[-_]?card|card[-_]?nonce)$", "high")]),
    ("merchant_id", "financial_info", "high", [(r"^merchant[-_]?(id|number|code)$", "high"), (r"^(terminal[-_]?id|acquirer[-_]?id)$", "high")]),
    ("payment_account", "financial_info", "critical", [(r"^(payment[-_]?account|billing[-_]?account|cardholder[-_]?name)$", "high"), (r"^(cvv|cvc|cvv2|cid|security[-_]?code)$", "high"), (r"^(expir(y|ation)[-_]?date|exp[-_]?month|exp[-_]?year)$", "high")]),
    ("biometric", "biometric_data", "critical", [(r"^biometric[-_]?(data|id|hash|template)?$", "high")]),
    ("face_image", "biometric_data", "critical", [(r"^face[-_]?(image|photo|data|encoding|embedding)$", "high"), (r"^(profile[-_]?photo|avatar[-_]?image|selfie)$", "medium")]),
    ("fingerprint", "biometric_data", "critical", [(r"^fingerprint[-_]?(data|hash|template|id)?$", "high")]),
    ("user_agent", "browser_device", "low", [(r"^user[-_]?agent$", "high")]),
    ("device_id", "browser_device", "medium", [(r"^device[-_]?(id|identifier|fingerprint)$", "high"), (r"^(udid|imei)$", "high")]),
    ("cookie", "browser_device", "medium", [(r"^(cookie|session[-_]?cookie|tracking[-_]?cookie)$", "high"), (r"^set[-_]?cookie$", "medium")]),
    ("mac_address", "network_identifier", "medium", [(r"^mac[-_]?addr(ess)?$", "high")]),
    ("session_id", "browser_device", "medium", [(r"^session[-_]?(id|key|token)$", "high"), (r"^sid$", "medium")]),
    ("gps_coordinates", "network_identifier", "medium", [(r"^(gps|geo)[-_]?(loc(ation)?|coord(inates)?|lat(itude)?|lng|lon(gitude)?)$", "high"), (r"^(latitude|longitude)$", "high")]),
    ("student_id", "education_employment", "high", [(r"^student[-_]?(id|number|num|no)$", "high")]),
    ("employee_id", "education_employment", "high", [(r"^employee[-_]?(id|number|num|no)$", "high"), (r"^(staff|worker|personnel)[-_]?(id|number)$", "high")]),
    ("social_media_handle", "education_employment", "medium", [(r"^(twitter|instagram|facebook|linkedin|tiktok|github)[-_]?(handle|username|id|profile)$", "high"), (r"^social[-_]?media[-_]?(handle|username|id)$", "high")]),
]

SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
