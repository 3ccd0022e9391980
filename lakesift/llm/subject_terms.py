"""Curated terms of the subject areas (fixed values), in five languages, in natural order.

A term may stand under several subjects; it then speaks for each with a part of its weight.
"""

TERMS: dict[str, dict[str, str]] = {
    "health": {
        "en": "admission, allergy, blood panel, chart, claim, clinic, diagnosis, discharge letter, dosage, infusion, midwife, nurse, patient, pharmacist, "
        "physician, prescription, record, referral, surgery, symptom, therapy plan, triage desk, trial, vaccine, ward, x-ray, medication, hospital",
        "de": "klinik, rezept, patientin, allergie, blutwert, diagnose, pflegekraft, impfung",
        "fr": "ordonnance, clinique, diagnostic, patiente, vaccin, infirmier, chirurgie, allergie",
        "es": "alergia, receta, diagnóstico, clínica, cirugía, enfermera, vacuna, paciente",
        "ja": "看護師, 診療所, 患者, 処方箋",
    },
    "banking": {
        "en": "account, balance, branch, broker, card holder, charge, claim, credit line, deposit, dividend, exchange rate, fraud desk, instalment, interest rate, "
        "ledger, loan, mortgage, overdraft, portfolio, savings book, savings plan, settlement, standing order, statement, teller, transfer",
        "de": "überweisung, guthaben, filiale, darlehen, kreditkarte, konto, zinssatz, sparplan",
        "fr": "découvert, virement, carte bancaire, compte, prêt, épargne, agence, intérêts",
        "es": "transferencia, préstamo, interés, tarjeta, hipoteca, ahorro, cuenta, sucursal",
        "ja": "口座, 振込, 利率, 融資",
    },
    "law": {
        "en": "affidavit, appeal, attorney, case file, charge, claim, contract clause, counsel, court, defendant, deposition, docket, hearing, injunction, judge, jury, "
        "lawsuit, notary, plaintiff, probate, settlement, statute, tenant dispute, trial, verdict, witness",
        "de": "gericht, berufung, urteil, klage, richterin, anwältin, vertrag, zeugin",
        "fr": "appel, témoin, tribunal, juge, jugement, plainte, contrat, avocate",
        "es": "jueza, testigo, abogada, contrato, tribunal, apelación, demanda, sentencia",
        "ja": "契約書, 裁判所, 証人, 判決",
    },
    "sport": {
        "en": "captain, club, coach, court, fan pass, fixture list, goalkeeper, heat, injury list, league, marathon, match, medal, racket, referee, relay, scoreboard, "
        "season, sprint, squad, stadium, striker, swimmer, tournament, training camp, transfer",
        "de": "torwart, spieltag, stürmerin, liga, trainer, verein, stadion, turnier",
        "fr": "arbitre, match, entraîneur, attaquante, tournoi, stade, club, ligue",
        "es": "partido, estadio, delantera, árbitro, entrenador, torneo, club, liga",
        "ja": "試合, 球場, 選手, 監督",
    },
    "science": {
        "en": "assay, calibration, catalyst, cell, centrifuge, current, dataset, experiment, field station, genome, hypothesis, isotope, lab notebook, laboratory, "
        "measurement, microscope, particle, reagent, replication, sample tray, sequence, species, specimen, spectrum, telescope, trial",
        "de": "labor, versuch, hypothese, messung, genom, probe, mikroskop, teilchen",
        "fr": "hypothèse, microscope, particule, expérience, échantillon, laboratoire, mesure, génome",
        "es": "microscopio, muestra, genoma, partícula, medición, laboratorio, experimento, hipótesis",
        "ja": "標本, 研究室, 顕微鏡, 測定",
    },
    "education": {
        "en": "attendance list, campus, classroom, coach, course, curriculum, diploma, dormitory, enrolment, exam, faculty, grade, homework, kindergarten, lecture, lesson, "
        "pupil, quiz, report card, scholarship, school year, seminar, teacher, thesis, timetable, tutor",
        "de": "stundenplan, lehrkraft, zeugnis, schülerin, hörsaal, prüfung, schuljahr, unterricht",
        "fr": "examen, rentrée, élève, enseignante, cours, amphithéâtre, bulletin, devoirs",
        "es": "profesor, matrícula, boletín, clase, tarea, aula, alumna, examen",
        "ja": "試験, 生徒, 授業, 教師",
    },
    "retail": {
        "en": "barcode, basket, cashier, catalogue, channel, checkout, delivery slot, discount, gift card, loyalty card, order line, outlet, parcel, price tag, receipt, "
        "refund, returns desk, season, season sale, shelf, shopper, stock level, store, supplier, voucher, warehouse, wish list",
        "de": "gutschein, lieferung, lagerbestand, kasse, rabatt, filialleitung, warenkorb, regal",
        "fr": "rayon, stock, caisse, panier, bon d’achat, magasin, remise, livraison",
        "es": "almacén, tienda, estante, descuento, vale, carrito, caja, entrega",
        "ja": "割引, 在庫, 買い物かご, 店舗",
    },
    "travel": {
        "en": "airport, boarding pass, booking, cabin, campsite, check-in desk, coach, cruise, ferry, flight, gate, hostel, hotel, itinerary, layover, luggage, passenger, rail pass, "
        "resort, season, seat map, sightseeing, tour guide, transfer, travel agent, visa",
        "de": "flug, buchung, bordkarte, hotel, fähre, gepäck, reiseleitung, flughafen",
        "fr": "passager, croisière, aéroport, itinéraire, bagage, vol, hôtel, réservation",
        "es": "reserva, aeropuerto, hotel, equipaje, crucero, vuelo, itinerario, pasajera",
        "ja": "予約, 旅館, 空港, 搭乗券",
    },
    "energy": {
        "en": "battery pack, boiler, cell, charge, current, district heating, feed-in, gas line, generator, heat, heat pump, household supply, insulation, kilowatt hour, load curve, "
        "meter, outage, peak demand, pipeline, power grid, reactor, solar panel, substation, tariff, transformer, turbine, wind farm",
        "de": "solaranlage, umspannwerk, heizung, netz, tarif, kraftwerk, windpark, stromzähler",
        "fr": "panne, éolienne, compteur, panneau solaire, réseau électrique, centrale, tarif, chaudière",
        "es": "panel solar, tarifa, red eléctrica, contador, aerogenerador, central, caldera, apagón",
        "ja": "送電網, 電力計, 料金表, 発電所",
    },
    "media": {
        "en": "album, audience share, broadcast, camera crew, cartoon, channel, column, concert, editor, film reel, headline, interview, journalist, magazine, newsroom, playlist, "
        "podcast, premiere, print run, royalty, script, season, soundtrack, stream, studio, subscriber",
        "de": "filmrolle, hörspiel, redaktion, sendung, zeitschrift, studio, abonnent, schlagzeile",
        "fr": "abonné, studio, gros titre, magazine, concert, émission, rédaction, tournage",
        "es": "suscriptora, redacción, estudio, emisión, revista, rodaje, concierto, titular",
        "ja": "映画, 雑誌, 番組, 編集部",
    },
}

#: Common turns of phrase in which a term means something else.
IDIOMS = "in charge, no charge for, on record, of course, in the course of, current version, current state, build script, column name"

#: Weight of a term of several words: it is less likely to mean something else than a single word, which weighs 1.
PHRASE_WEIGHT = 1.25
