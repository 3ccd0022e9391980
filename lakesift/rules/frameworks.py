"""The built-in regulation rules (fixed values), in order."""

from __future__ import annotations

#: (framework, article, title, trigger, risk, recommendation); a trigger is ``sink:<kind>``, ``flow`` or the name of a group of types.
RULES: list[tuple[str, str, str, str, str, str]] = [
    ("gdpr", "Art.5(1f)", "Integrity and Confidentiality", "sink:log_output",
     "PII written to logs without protection violates data security obligation",
     "Implement log sanitization or masking for PII fields before logging"),
    ("gdpr", "Art.13", "Information to be Provided", "sink:third_party_api",
     "PII shared with third party without documented legal basis",
     "Document the legal basis for sharing and update privacy notice"),
    ("gdpr", "Art.25", "Data Protection by Design", "sensitive",
     "Sensitive PII processed without privacy-by-design safeguards",
     "Apply field-level encryption or pseudonymization for sensitive PII"),
    ("gdpr", "Art.30", "Records of Processing Activities", "sink:database",
     "PII processing activity detected -- ensure RoPA entry exists",
     "Add this processing activity to your Records of Processing Activities"),
    ("gdpr", "Art.32", "Security of Processing", "sink:log_output",
     "PII in logs may be accessible to unauthorized personnel",
     "Restrict log access and implement PII masking in log output"),
    ("gdpr", "Art.44", "General Principle for Transfers", "sink:third_party_api",
     "PII may be transferred to third-party service outside EU/EEA",
     "Verify data residency of third-party services and implement transfer safeguards"),
    ("ccpa", "§1798.100(b)", "Right to Know -- Collection Disclosure", "flow",
     "Personal information collected without adequate disclosure",
     "Update privacy policy to disclose categories of PI collected and purposes"),
    ("ccpa", "§1798.100(d)", "Data Minimization", "sensitive",
     "Sensitive personal information may exceed what is necessary",
     "Review data collection to ensure minimization principle is met"),
    ("ccpa", "§1798.150", "Personal Information Security", "sink:log_output",
     "Unprotected personal information in logs creates breach liability",
     "Encrypt or mask personal information before logging to prevent breach exposure"),
    ("appi", "Art.17", "Specifying Utilization Purpose", "flow",
     "Personal information collected without specified utilization purpose",
     "Specify and document the utilization purpose for this personal information as required by APPI Art.17"),
    ("appi", "Art.20", "Security Control Actions", "sink:log_output",
     "Personal information leaked to logs without security controls",
     "Implement necessary and appropriate security control actions (access control, encryption, masking) per APPI Art.20"),
    ("appi", "Art.20", "Security Control Actions (Storage)", "sink:database",
     "Personal information stored without adequate security controls",
     "Apply encryption at rest and access control for personal information databases per APPI Art.20"),
    ("appi", "Art.23", "Restriction on Provision to Third Parties", "sink:third_party_api",
     "Personal information provided to third party without consent",
     "Obtain prior consent from the data subject before providing personal information to third parties per APPI Art.23"),
    ("appi", "Art.24", "Restriction on Cross-Border Transfer", "sink:third_party_api",
     "Personal information may be transferred to a foreign third party",
     "Ensure foreign transfer complies with APPI Art.24 (consent, adequate protection, or contractual safeguards)"),
    ("appi", "Art.2(3)", "Special Care-Required Personal Information", "sensitive",
     "Special care-required personal information detected (race, creed, social status, medical history, criminal record, etc.)",
     "Obtain explicit consent before acquiring special care-required personal information per APPI Art.2(3) and Art.20(2)"),
    ("appi", "Art.2(3)", "Special Care-Required Personal Information (Biometric)", "biometric",
     "Biometric data classified as special care-required personal information under APPI",
     "Apply strict access controls and obtain explicit consent for biometric data processing"),
    ("appi", "MyNumber Act Art.9", "Restriction on Use of Individual Number", "japan",
     "Individual Number (My Number) detected -- use is strictly restricted to social security, tax, and disaster response",
     "Ensure My Number is used only for legally permitted purposes. Apply encryption and strict access control per My Number Act Art.9 and Art.12"),
    ("appi", "MyNumber Act Art.12", "Security Measures for Individual Number", "japan",
     "Individual Number may be exposed without required security measures",
     "Implement necessary measures to prevent leakage, loss, or damage of Individual Numbers per My Number Act Art.12"),
    ("hipaa", "164.502(a)", "Uses and Disclosures of PHI", "health",
     "Protected Health Information (PHI) detected in code",
     "Ensure PHI is used only for permitted purposes (treatment, payment, operations) per HIPAA 164.502(a)"),
    ("hipaa", "164.312(a)(1)", "Access Control", "health",
     "PHI may be accessible without proper access controls",
     "Implement technical safeguards to restrict PHI access to authorized users per HIPAA 164.312(a)(1)"),
    ("hipaa", "164.312(a)(2)(iv)", "Encryption and Decryption", "sink:database",
     "PHI stored without encryption",
     "Encrypt PHI at rest using AES-256 or equivalent per HIPAA 164.312(a)(2)(iv)"),
    ("hipaa", "164.312(e)(1)", "Transmission Security", "sink:third_party_api",
     "PHI may be transmitted without encryption",
     "Encrypt PHI in transit (TLS 1.2+) per HIPAA 164.312(e)(1)"),
    ("hipaa", "164.312(b)", "Audit Controls", "sink:log_output",
     "PHI logged without audit controls -- may violate minimum necessary standard",
     "Implement audit logging for PHI access and remove PHI from application logs per HIPAA 164.312(b)"),
    ("hipaa", "164.514(a)", "De-identification Standard", "sink:response",
     "PHI returned in API response without de-identification",
     "Apply Safe Harbor or Expert Determination de-identification before exposing health data per HIPAA 164.514(a)"),
    ("hipaa", "164.530(c)", "Administrative Safeguards", "sensitive",
     "Sensitive data handling detected -- ensure workforce training and policies are in place",
     "Maintain documented policies and train workforce on PHI handling per HIPAA 164.530(c)"),
    ("pci_dss", "Req 3.4", "Render PAN Unreadable", "payment",
     "Primary Account Number (PAN) or payment data detected in code",
     "Render PAN unreadable anywhere it is stored (truncation, hashing, tokenization, or encryption) per PCI-DSS Req 3.4"),
    ("pci_dss", "Req 3.3", "Mask PAN When Displayed", "sink:response",
     "Payment card data may be displayed without masking",
     "Mask PAN when displayed (show only first 6 and last 4 digits) per PCI-DSS Req 3.3"),
    ("pci_dss", "Req 3.2", "Do Not Store Sensitive Authentication Data", "credential",
     "Sensitive authentication data (CVV, PIN, full track data) must not be stored after authorization",
     "Never store CVV, PIN, or full track data after transaction authorization per PCI-DSS Req 3.2"),
    ("pci_dss", "Req 4.1", "Encrypt Cardholder Data in Transit", "sink:third_party_api",
     "Cardholder data may be transmitted without strong encryption",
     "Use TLS 1.2+ for all transmission of cardholder data over open networks per PCI-DSS Req 4.1"),
    ("pci_dss", "Req 3.5", "Protect Encryption Keys", "sink:log_output",
     "Payment data or encryption keys may be leaked to logs",
     "Never log cardholder data or cryptographic keys. Implement log filtering per PCI-DSS Req 3.5"),
    ("pci_dss", "Req 6.5", "Address Common Coding Vulnerabilities", "sink:database",
     "Cardholder data stored in database -- ensure encryption at rest",
     "Encrypt stored cardholder data and use parameterized queries per PCI-DSS Req 6.5"),
]

#: Types of each group a trigger may name.
GROUPS: dict[str, list[str]] = {
    "sensitive": ["national_id", "credit_card", "password", "health_data", "medical_record", "passport_number", "bank_account", "my_number", "biometric", "fingerprint", "face_image", "diagnosis", "prescription"],
    "japan": ["my_number", "national_id"],
    "biometric": ["biometric", "fingerprint", "face_image"],
    "health": ["health_data", "medical_record", "diagnosis", "prescription", "patient_id", "insurance_claim_id", "lab_result"],
    "payment": ["credit_card", "bank_account", "iban", "card_token", "merchant_id", "payment_account", "bank_routing_number", "swift_code"],
    "credential": ["password", "auth_token", "api_key", "private_key", "secret_key"],
}

FRAMEWORKS = ["gdpr", "ccpa", "appi", "hipaa", "pci_dss"]
