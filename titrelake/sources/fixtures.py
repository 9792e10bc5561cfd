"""A small invented evidence base for tests and demonstrations; none of it is real literature."""

STUDIES = [
    {"study_id": "alpha", "citation": "Alpha A. (2021). Invented trial of a nasal vaccine.", "year": 2021, "pathogen": "influenza", "vaccines": [("laiv", "influenza", "live_attenuated", "intranasal")], "sampling_methods": ["nasal_wash", "serum"], "compartments": ["nasal", "serum"], "timepoints_days": [0, 7, 28, 180], "assays": ["elisa_binding"], "abstract": "Nasal IgA rose within two weeks after the live attenuated vaccine. Serum IgG did not rise in most adults. The peak of nasal IgA was seen on day 14 after vaccination.", "full_text_excerpts": "Nasal wash samples were taken on day 0, 7, 28 and 180.", "findings": [("bean2024_f2", "Nasal and serum responses differ", "Nasal IgA rose within two weeks after the live attenuated vaccine.", ["compartmentalization"], "verified_abstract"), ("bean2024_f3", "Serum did not rise", "Serum IgG did not rise in most adults.", ["prior_immunity"], "verified_abstract")], "not_reported": [], "level": "verified_abstract"},
    {"study_id": "beta", "citation": "Beta B. (2022). Invented comparison of devices.", "year": 2022, "pathogen": "influenza", "vaccines": [("iiv", "influenza", "inactivated", "intramuscular")], "sampling_methods": ["nasosorption"], "compartments": ["nasal"], "timepoints_days": [0, 28], "assays": ["multiplex_binding"], "abstract": "Absorptive strips recovered more IgA than nasal washes in the same subjects. Dilution varied between visits for washes. Responses persisted for six months in half of the participants.", "full_text_excerpts": "", "findings": [("tsunetsugu2022_f1", "Strips recover more", "Absorptive strips recovered more IgA than nasal washes in the same subjects.", ["sampling_method"], "verified_abstract"), ("sheikhmohamed2022_f2", "Persistence", "Responses persisted for six months in half of the participants.", ["kinetics", "responder_rate"], "verified_abstract")], "not_reported": ["lloq"], "level": "verified_fulltext"},
    {"study_id": "gamma", "citation": "Gamma C. (2020). Placeholder.", "year": 2020, "pathogen": "RSV", "vaccines": [("ad", "RSV", "adenovirus_vector", "intranasal")], "sampling_methods": ["saliva"], "compartments": ["oral"], "timepoints_days": [], "assays": [], "abstract": "", "full_text_excerpts": "", "findings": [], "not_reported": [], "level": "to_verify"},
]
