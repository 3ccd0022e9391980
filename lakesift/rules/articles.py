"""Descriptions of the regulation articles (fixed values), in order."""

from __future__ import annotations

ARTICLES: list[tuple[str, str, str, str]] = [
    ("gdpr", "Art.5(1f)", "Integrity and Confidentiality",
     "Personal data shall be processed in a manner that ensures appropriate security, including protection against unauthorised or unlawful processing and against accidental loss, destruction or damage."),
    ("gdpr", "Art.13", "Information to be Provided Where Personal Data are Collected",
     "The controller shall provide the data subject with information about the purposes of processing, recipients of personal data, and the existence of data subject rights."),
    ("gdpr", "Art.25", "Data Protection by Design and by Default",
     "The controller shall implement appropriate technical and organisational measures for ensuring that only personal data necessary for each specific purpose are processed."),
    ("gdpr", "Art.30", "Records of Processing Activities",
     "Each controller shall maintain a record of processing activities under its responsibility, including purposes, categories of data subjects, and categories of personal data."),
    ("gdpr", "Art.32", "Security of Processing",
     "The controller and processor shall implement appropriate technical and organisational measures to ensure a level of security appropriate to the risk."),
    ("gdpr", "Art.44", "General Principle for Transfers",
     "Any transfer of personal data to a third country shall take place only if the conditions laid down in this Chapter are complied with."),
    ("ccpa", "§1798.100(b)", "Right to Know — Collection Disclosure",
     "A business that collects a consumer's personal information shall disclose the categories of personal information collected and the purposes for which the information is used."),
    ("ccpa", "§1798.100(d)", "Data Minimization",
     "A business shall not collect additional categories of personal information or use personal information for additional purposes without providing the consumer with notice."),
    ("ccpa", "§1798.150", "Personal Information Security",
     "Any consumer whose nonencrypted and nonredacted personal information is subject to unauthorized access may institute a civil action for damages."),
    ("appi", "Art.2(1)", "Definition of Personal Information",
     "Personal information means information relating to a living individual which can identify the specific individual by name, date of birth, or other description contained in such information, or which includes an individual identification code."),
    ("appi", "Art.2(3)", "Special Care-Required Personal Information",
     "Information concerning a person's race, creed, social status, medical history, criminal record, fact of having suffered damage by a crime, and other descriptions requiring special care in handling."),
    ("appi", "Art.17", "Specifying the Utilization Purpose",
     "A personal information handling business operator shall specify the utilization purpose of personal information as much as possible."),
    ("appi", "Art.18", "Restriction on Utilization Purpose",
     "A personal information handling business operator shall not handle personal information beyond the scope necessary for achieving the utilization purpose without obtaining the consent of the person."),
    ("appi", "Art.20", "Security Control Actions",
     "A personal information handling business operator shall take necessary and appropriate action for the security control of personal data including preventing the leakage, loss, or damage of the personal data."),
    ("appi", "Art.23", "Restriction on Provision to Third Parties",
     "A personal information handling business operator shall not provide personal data to a third party without obtaining the prior consent of the person, except in cases prescribed by law."),
    ("appi", "Art.24", "Restriction on Provision to Third Parties in Foreign Countries",
     "A personal information handling business operator shall not provide personal data to a third party in a foreign country without the consent of the person, unless the country has a personal information protection system recognized as equivalent."),
    ("appi", "Art.25", "Confirmation at the Time of Receiving Provision from Third Parties",
     "When receiving personal data from a third party, a personal information handling business operator shall confirm the name and address of the third party and the circumstances of the acquisition."),
    ("appi", "MyNumber Act Art.9", "Restriction on Use of Individual Number",
     "No person shall use the Individual Number of another person beyond the scope necessary for the affairs prescribed by this Act (social security, tax, and disaster response)."),
    ("appi", "MyNumber Act Art.12", "Security Measures for Individual Number",
     "Any person who handles Individual Numbers shall take necessary measures to prevent leakage, loss, or damage of the specific personal information related to Individual Numbers."),
    ("hipaa", "164.502(a)", "Uses and Disclosures of PHI",
     "A covered entity or business associate may not use or disclose protected health information except as permitted or required."),
    ("hipaa", "164.312(a)(1)", "Access Control",
     "Implement technical policies and procedures for electronic information systems that maintain electronic protected health information to allow access only to those persons or software programs that have been granted access rights."),
    ("hipaa", "164.312(a)(2)(iv)", "Encryption and Decryption",
     "Implement a mechanism to encrypt and decrypt electronic protected health information."),
    ("hipaa", "164.312(b)", "Audit Controls",
     "Implement hardware, software, and/or procedural mechanisms that record and examine activity in information systems that contain or use electronic protected health information."),
    ("hipaa", "164.312(e)(1)", "Transmission Security",
     "Implement technical security measures to guard against unauthorized access to electronic protected health information that is being transmitted over an electronic communications network."),
    ("hipaa", "164.514(a)", "De-identification Standard",
     "Health information that does not identify an individual and with respect to which there is no reasonable basis to believe that the information can be used to identify an individual is not individually identifiable health information."),
    ("hipaa", "164.530(c)", "Administrative Safeguards - Training",
     "A covered entity must train all members of its workforce on the policies and procedures with respect to protected health information."),
    ("pci_dss", "Req 3.2", "Do Not Store Sensitive Authentication Data After Authorization",
     "Do not store sensitive authentication data after authorization (even if encrypted). Sensitive authentication data includes full track data, card verification codes/values, and PINs/PIN blocks."),
    ("pci_dss", "Req 3.3", "Mask PAN When Displayed",
     "Mask PAN when displayed (the first six and last four digits are the maximum number of digits to be displayed), such that only personnel with a legitimate business need can see more than the first six/last four digits of the PAN."),
    ("pci_dss", "Req 3.4", "Render PAN Unreadable Anywhere It Is Stored",
     "Render PAN unreadable anywhere it is stored by using any of the following approaches: one-way hashes, truncation, index tokens, or strong cryptography with associated key-management processes."),
    ("pci_dss", "Req 3.5", "Document and Implement Procedures to Protect Keys",
     "Document and implement procedures to protect keys used to secure stored cardholder data against disclosure and misuse."),
    ("pci_dss", "Req 4.1", "Use Strong Cryptography to Safeguard Cardholder Data During Transmission",
     "Use strong cryptography and security protocols to safeguard sensitive cardholder data during transmission over open, public networks, including TLS 1.2 or higher."),
    ("pci_dss", "Req 6.5", "Address Common Coding Vulnerabilities in Software-Development Processes",
     "Address common coding vulnerabilities in software-development processes including injection flaws, buffer overflows, insecure cryptographic storage, and improper error handling."),
]
