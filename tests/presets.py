"""Fixture: the four preset customers of the prediction form."""

# --- fixed values: the four preset customers of the prediction form -------------
PRESET_COLUMNS = ("preset", "expected_band", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
                  "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                  "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "MonthlyCharges",
                  "TotalCharges")


def preset_profiles(spark):
    """The form's four preset customers with their expected risk band."""
    rows = [
        ("high_risk", "85-98", "Female", 1, "No", "No", 1, "Yes", "Yes", "Fiber optic", "No", "No", "No", "No", "Yes", "Yes",
         "Month-to-month", "Yes", "Electronic check", 110.5, 110.5),
        ("loyal", "5-15", "Male", 0, "Yes", "Yes", 70, "Yes", "Yes", "DSL", "Yes", "Yes", "Yes", "Yes", "No", "No",
         "Two year", "No", "Credit card (automatic)", 35.0, 2450.0),
        ("moderate", "35-50", "Female", 0, "Yes", "No", 24, "Yes", "No", "Fiber optic", "No", "Yes", "Yes", "No", "Yes", "No",
         "One year", "Yes", "Bank transfer (automatic)", 75.0, 1800.0),
        ("budget", "8-20", "Male", 0, "No", "No", 50, "Yes", "No", "No", "No internet service", "No internet service",
         "No internet service", "No internet service", "No internet service", "No internet service",
         "Two year", "No", "Mailed check", 20.0, 1000.0),
    ]
    return spark.createDataFrame(rows, list(PRESET_COLUMNS))
