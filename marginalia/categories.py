"""Default category list."""

# The category names, in output order.
DEFAULT_CATEGORIES = (
    "Колектив",
    "Умови праці",
    "Робочі процеси та практики",
    "Визнання співробітників та винагорода",
    "Імідж компанії",
    "Навчання та розвиток",
    "Ефективність управління",
    "Зміст роботи",
    "Добробут співробітників",
    "Взаємодія та комунікація",
    "Баланс робота-особисте життя",
    "Внутрішня мотивація",
    "Інше",
)
